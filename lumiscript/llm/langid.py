"""Problem 1: the language of each text and of each passage in it.

Hierarchical discrimination. A linear support vector machine per family tells
the families apart (Vietic, Sinitic, Slavic, Western European); inside a family
of several languages one machine per pair of languages votes. All machines are
linear in the words of a segment, so a word is scored once per process and a
segment is the mean of its words. Confidence is the logistic of the decision
margin, fitted on held-out segments.

The machines learn from right-labelled samples and, in a second round, from a
bounded sample of the corpus (``corpus_rows``, in an order by hash) of which
only sentences count whose label agrees with the first round.

Defined results: a null or empty text, or one without letters, has no segment
and no language; a repeated row gives its segments once per row; ties between
languages go to the first in the order of ``LANGS``.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiscript.llm.common import bounded_rows, bounded_sample, composed, crc, folded

LANGS = ("vi", "en", "fr", "es", "zh", "ru")
FAMILIES = ("vietic", "western", "sinitic", "slavic")
FAMILY_OF = {"vi": "vietic", "en": "western", "fr": "western", "es": "western", "zh": "sinitic", "ru": "slavic"}
#: Other spellings of the codes (ISO 639-2 and 639-3).
ALIASES = {"vie": "vi", "eng": "en", "fra": "fr", "fre": "fr", "spa": "es", "zho": "zh", "chi": "zh", "cmn": "zh", "rus": "ru"}
DIM = 1 << 15
MIN_WORDS, MIN_HAN = 6, 10
HAN_WEIGHT = MIN_WORDS / MIN_HAN
#: Words and ends of sentences; a stop inside a number ends nothing.
TOKENS = re.compile(r"[^\W\d_]+|[.!?…;:]+(?=\s|$)|[。！？；]|\n")
LETTERS = re.compile(r"[^\W\d_]+")
HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿]")
CYRILLIC = re.compile(r"[Ѐ-ԯ]")
MARKED = re.compile(r"[ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉĩịọỏốồổỗộớờởỡợụủũứừửữựỳỵỷỹ]")


def normal_label(label):
    """Column: the language code of a label, whatever its case and region; null for none or a placeholder."""
    code = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]{2,3})(?:$|[-_])", 1))
    names = F.create_map(*[F.lit(x) for pair in [*ALIASES.items(), *zip(LANGS, LANGS)] for x in pair])
    return F.element_at(names, code)


def word_features(word: str) -> np.ndarray:
    """Hashed features of a word: itself, its character n-grams, its script."""
    w = word.lower()
    if HAN.search(w):
        grams = {"s:han", *w}
    else:
        b = f"^{w}$"
        grams = {b, *(b[i : i + n] for n in (2, 3, 4) for i in range(len(b) - n + 1))}
        if CYRILLIC.search(w):
            grams.add("s:cyr")
        elif MARKED.search(w):
            grams.add("s:marked")
        else:
            grams.add("s:latin")
    return np.fromiter((crc(g) & (DIM - 1) for g in sorted(grams)), np.int64, len(grams))


def svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float = 1.0, epochs: int = 8, seed: int = 7) -> np.ndarray:
    """Linear SVM with squared hinge loss by dual coordinate descent; the last weight is the bias."""
    w = np.zeros(DIM + 1)
    alpha = np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for _, v in rows]) + 0.5 / c
    order = np.arange(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            k, v = rows[i]
            g = y[i] * (w[k] @ v + w[DIM]) - 1 + alpha[i] * 0.5 / c
            new = max(0.0, alpha[i] - g / norm[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[k] += step * v
                w[DIM] += step
                alpha[i] = new
    return w


def logistic_fit(margin: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """Platt's a, b with P(right) = 1 / (1 + exp(-(a m + b))), by Newton steps with a weak prior."""
    a, b = 1.0, 0.0
    t = np.where(right, (right.sum() + 1) / (right.sum() + 2), 1 / ((~right).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - t) * margin).sum() + 1e-2 * (a - 1), (p - t).sum() + 1e-2 * b])
        q = p * (1 - p)
        h = np.array([[(q * margin * margin).sum() + 1e-2, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def pairs_of(family: str) -> list[tuple[str, str]]:
    own = [x for x in LANGS if FAMILY_OF[x] == family]
    return [(a, b) for i, a in enumerate(own) for b in own[i + 1 :]]


PAIRS = [p for f in FAMILIES for p in pairs_of(f)]


@dataclass
class LangModel:
    """Weights: a column for each family, then one for each pair of languages."""

    weights: np.ndarray
    platt: tuple[float, float] = (1.0, 0.0)
    words: dict = field(default_factory=dict)
    scores: np.ndarray = field(default_factory=lambda: np.zeros((1024, len(FAMILIES) + len(PAIRS)), np.float32))
    size: np.ndarray = field(default_factory=lambda: np.zeros(1024, np.float32))

    def __getstate__(self):
        return {"weights": self.weights, "platt": self.platt}

    def __setstate__(self, s):
        self.__init__(s["weights"], s["platt"])

    def add(self, word: str) -> int:
        k = len(self.words)
        if k == len(self.size):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        if word[0].isalpha():
            f = word_features(word)
            self.scores[k] = self.weights[f].sum(0) / math.sqrt(len(f)) + self.weights[DIM]
            self.size[k] = len(word) * HAN_WEIGHT if HAN.search(word) else 1
            self.scores[k] *= self.size[k]
        else:
            self.size[k] = 0  # ends a sentence
        self.words[word] = k
        return k

    def ids(self, tokens: list[str]) -> np.ndarray:
        if len(self.words) > 400_000:
            self.words.clear()
        get, add = self.words.get, self.add
        return np.array([i if (i := get(t)) is not None else add(t) for t in tokens], np.int64)

    def decide(self, sums: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and margin of segments from their summed scores and sizes."""
        if not len(sums):
            return np.zeros(0, np.int64), np.zeros(0)
        mean = sums / np.maximum(n, 1e-6)[:, None]
        fam = mean[:, : len(FAMILIES)]
        best = fam.argmax(1)
        top = np.sort(fam, 1)
        margin = top[:, -1] - top[:, -2]
        lang = np.zeros(len(sums), np.int64)
        for f, name in enumerate(FAMILIES):
            own = [x for x in LANGS if FAMILY_OF[x] == name]
            at = np.flatnonzero(best == f)
            if len(own) == 1:
                lang[at] = LANGS.index(own[0])
                continue
            votes = np.zeros((len(at), len(own)))
            for p, (a, b) in enumerate(PAIRS):
                if a in own:
                    s = mean[at, len(FAMILIES) + p]
                    votes[:, own.index(a)] += (s >= 0) + 1e-3 * np.tanh(s)
                    votes[:, own.index(b)] += (s < 0) - 1e-3 * np.tanh(s)
            win = votes.argmax(1)
            lang[at] = np.array([LANGS.index(x) for x in own])[win]
            for k, x in enumerate(own):
                sides = [mean[at, len(FAMILIES) + p] * (1 if a == x else -1) for p, (a, b) in enumerate(PAIRS) if x in (a, b)]
                margin[at] = np.where(win == k, np.minimum(margin[at], np.min(sides, 0)), margin[at])
        return lang, margin

    def confidence(self, margin: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))

    def segments(self, texts: list[str]) -> pd.DataFrame:
        """Passages of the texts: row, n (words, Han characters at 0.6), lang, margin; runs of sentences of one language are one passage."""
        tokens, lens = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                found = TOKENS.findall(composed(t))
                lens[i] = len(found)
                tokens += found
        ids = self.ids(tokens)
        row = np.repeat(np.arange(len(texts)), lens)
        n = self.size[ids]
        word = n > 0
        # A sentence ends at a stop or with its text.
        cut = np.zeros(len(ids) + 1, np.int64)
        cut[1:] = np.cumsum(~word)
        unit = cut[:-1] + row
        ids, row, n, unit = ids[word], row[word], n[word], unit[word]
        if not len(ids):
            return pd.DataFrame({"row": [], "n": [], "lang": [], "margin": []})
        start = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        s = self.scores[ids]
        sums, size = np.add.reduceat(s, start), np.add.reduceat(n, start)
        lang, margin = self.decide(sums, size)
        u_row = row[start]
        pieces = self.split(s, n, start, lang, u_row)
        if pieces is not None:
            sums, size, lang, margin, u_row = pieces
        # A sentence that is too short to be a passage, or is unsure, goes with its neighbours.
        weak = (size < 3) | (margin < 0.05)
        if weak.any():
            strong = np.flatnonzero(~weak)
            if len(strong):
                for side in ("left", "right"):
                    at = np.flatnonzero(weak)
                    near = np.searchsorted(strong, at) - (side == "left")
                    ok = (near >= 0) & (near < len(strong))
                    at, near = at[ok], strong[near[ok]]
                    ok = u_row[at] == u_row[near]
                    lang[at[ok]] = lang[near[ok]]
                    weak[at[ok]] = False
        run = np.flatnonzero(np.r_[True, (u_row[1:] != u_row[:-1]) | (lang[1:] != lang[:-1])])
        total = np.add.reduceat(size, run)
        weight = np.add.reduceat(margin * size, run) / np.maximum(total, 1e-6)
        return pd.DataFrame({"row": u_row[run], "n": total, "lang": lang[run], "margin": weight})

    def halves(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language and margin of the first half, the second half and the whole of each text by its words, and its size; no passages are looked for."""
        tokens, lens = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                found = LETTERS.findall(composed(t))
                lens[i] = len(found)
                tokens += found
        ids = self.ids(tokens)
        end = np.cumsum(lens)
        start = end - lens
        total, sizes = np.zeros((len(ids) + 1, self.scores.shape[1])), np.zeros(len(ids) + 1)
        total[1:], sizes[1:] = np.cumsum(self.scores[ids], 0), np.cumsum(self.size[ids])
        lang, margin = np.zeros((len(texts), 3), np.int64), np.zeros((len(texts), 3))
        middle = (start + end) // 2
        for k, (a, b) in enumerate(((start, middle), (middle, end), (start, end))):
            lang[:, k], margin[:, k] = self.decide(total[b] - total[a], sizes[b] - sizes[a])
            margin[a == b, k] = 0
        return lang, margin, sizes[end] - sizes[start]

    def split(self, s, n, start, lang, u_row):
        """Cuts sentences in which a run of six words or more is clearly of another language than the whole."""
        end = np.r_[start[1:], len(n)]
        k = MIN_WORDS
        if len(n) < k:
            return None
        total, sizes = np.zeros((len(n) + 1, s.shape[1])), np.zeros(len(n) + 1)
        total[1:], sizes[1:] = np.cumsum(s, 0), np.cumsum(n)
        at = np.arange(len(n) - k + 1)
        unit = np.repeat(np.arange(len(start)), end - start)
        at = at[unit[at] == unit[at + k - 1]]
        if not len(at):
            return None
        w_lang, w_margin = self.decide(total[at + k] - total[at], sizes[at + k] - sizes[at])
        odd = (w_lang != lang[unit[at]]) & (w_margin > 0.45)
        todo = np.unique(unit[at[odd]])
        if not len(todo):
            return None
        cuts = []
        for u in todo:
            path = self.path(s[start[u] : end[u]], n[start[u] : end[u]])
            cuts.append(start[u] + np.flatnonzero(path[1:] != path[:-1]) + 1)
        start = np.unique(np.concatenate([start, *cuts]))
        sums, size = np.add.reduceat(s, start), np.add.reduceat(n, start)
        lang, margin = self.decide(sums, size)
        return sums, size, lang, margin, u_row[unit[start]]

    def path(self, s: np.ndarray, n: np.ndarray, change: float = 4.0) -> np.ndarray:
        """The likeliest language of each word where each change has its price (Viterbi)."""
        score = np.full((len(n), len(LANGS)), 0.0)
        for k, x in enumerate(LANGS):
            score[:, k] = s[:, FAMILIES.index(FAMILY_OF[x])]
            sides = [s[:, len(FAMILIES) + p] * (1 if a == x else -1) for p, (a, b) in enumerate(PAIRS) if x in (a, b)]
            if sides:
                score[:, k] = np.minimum(score[:, k], np.min(sides, 0))
        back = np.zeros((len(n), len(LANGS)), np.int64)
        best = score[0].copy()
        for i in range(1, len(n)):
            top = best.argmax()
            stay = best >= best[top] - change
            back[i] = np.where(stay, np.arange(len(LANGS)), top)
            best = np.where(stay, best, best[top] - change) + score[i]
        out = np.zeros(len(n), np.int64)
        out[-1] = best.argmax()
        for i in range(len(n) - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out


def sentence_vectors(texts: list[str]) -> list[list[np.ndarray]]:
    """The sentences of each text as the word features of each."""
    cache: dict[str, np.ndarray] = {}
    out = []
    for t in texts:
        sentences, own = [], []
        for tok in [*TOKENS.findall(composed(t)), "\n"]:
            if tok[0].isalpha():
                if tok not in cache:
                    cache[tok] = word_features(tok)
                own.append((cache[tok], len(tok) * HAN_WEIGHT if HAN.search(tok) else 1.0))
            elif own:
                sentences.append(own)
                own = []
        out.append(sentences)
    return out


def vector(words: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray]:
    k = np.concatenate([f for f, _ in words])
    v = np.concatenate([np.full(len(f), size / math.sqrt(len(f))) for f, size in words]) / sum(size for _, size in words)
    uniq, inv = np.unique(k, return_inverse=True)
    return uniq, np.bincount(inv, v, len(uniq))


def train(texts: list[str], langs: list[str]) -> LangModel:
    """Fits the machines; every fifth sentence is held out for the confidence."""
    rows, y = [], []
    plain = [folded(t) for t, x in zip(texts, langs) if x == "vi"]  # Vietnamese without its marks is Vietnamese
    for sentences, lang in zip(sentence_vectors([*texts, *plain]), [*langs, *["vi"] * len(plain)]):
        for words in sentences:
            if len(words) >= 3 or sum(s for _, s in words) >= 3:
                rows.append(vector(words))
                y.append(LANGS.index(lang))
                if len(words) >= 2 * MIN_WORDS:  # passages can be short
                    rows.append(vector(words[: MIN_WORDS]))
                    y.append(LANGS.index(lang))
    y = np.array(y)
    held = np.arange(len(rows)) % 5 == 4
    known = [rows[i] for i in np.flatnonzero(~held)]
    cols = []
    for f in FAMILIES:
        own = np.isin(y[~held], [LANGS.index(x) for x in LANGS if FAMILY_OF[x] == f])
        cols.append(svm(known, np.where(own, 1.0, -1.0)))
    for a, b in PAIRS:
        at = np.flatnonzero(np.isin(y[~held], [LANGS.index(a), LANGS.index(b)]))
        cols.append(svm([known[i] for i in at], np.where(y[~held][at] == LANGS.index(a), 1.0, -1.0)))
    model = LangModel(np.stack(cols, 1))
    sums = np.array([model.weights[k].T @ v + model.weights[DIM] for k, v in (rows[i] for i in np.flatnonzero(held))]).reshape(-1, len(cols))
    lang, margin = model.decide(sums, np.ones(len(sums)))
    model.platt = logistic_fit(margin, lang == y[held])
    return model


def fit_languages(samples: DataFrame, corpus: DataFrame | None = None, corpus_rows: int = 1500, sample_rows: int = 5000) -> LangModel:
    """Learns from ``samples`` (text, lang) and from at most ``corpus_rows`` rows of ``corpus`` (id, text, lang)."""
    known = [r for r in bounded_rows(samples.select("text", normal_label(F.col("lang")).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL").orderBy("lang", F.xxhash64("text")), sample_rows, "the labelled sample")]
    texts, langs = [r.text for r in known], [r.lang for r in known]
    if not {*langs} >= {*LANGS}:
        raise ValueError(f"the labelled sample lacks {sorted({*LANGS} - {*langs})}")
    model = train(texts, langs)
    if corpus is None:
        return model
    own = corpus.select("id", "text", normal_label(F.col("lang")).alias("lang"))
    more = bounded_sample(own, "id", corpus_rows, "text IS NOT NULL AND lang IS NOT NULL")
    found = model.segments([r.text for r in more])
    whole = found.groupby("row").agg(lang=("lang", "nunique"), first=("lang", "first"), margin=("margin", "min"))
    for i, n, lang, margin in zip(whole.index, whole["lang"], whole["first"], whole["margin"]):
        r = more[int(i)]
        if n == 1 and LANGS[int(lang)] == r.lang and margin > 0.3:
            texts.append(r.text)
            langs.append(r.lang)
    return train(texts, langs)


def language_segments(df: DataFrame, model: LangModel, keys: list[str], text: str = "text") -> DataFrame:
    """Each passage's language: keys, seg (its number in the text), n_words, lang, confidence.

    A map over the rows without a shuffle; the model is a fixed 1.8 MB.
    """
    bc = df.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", seg bigint, n_words double, lang string, confidence double"

    def run(batches):
        m = bc.value
        for pdf in batches:
            for a in range(0, len(pdf), 500):
                part = pdf.iloc[a : a + 500].reset_index(drop=True)
                s = m.segments(part["_text"].tolist())
                at = s["row"].to_numpy(np.int64)
                seg = np.arange(len(at)) - np.searchsorted(at, at)
                yield pd.DataFrame({k: part[k].to_numpy()[at] for k in keys} | {"seg": seg, "n_words": s["n"].to_numpy(float), "lang": np.array(LANGS, object)[s["lang"].to_numpy(np.int64)], "confidence": m.confidence(s["margin"].to_numpy(float))})

    return df.select(*keys, F.col(text).alias("_text")).mapInPandas(run, schema)


def document_languages(df: DataFrame, model: LangModel, keys: list[str], text: str = "text") -> DataFrame:
    """One row per row of ``df`` that has words: keys, main language, its confidence, n_words, and the languages with a passage.

    The languages of a text are found within the map, so nothing is shuffled.
    """
    bc = df.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", main string, confidence double, n_words double, langs array<string>"

    def run(batches):
        m = bc.value
        for pdf in batches:
            for a in range(0, len(pdf), 500):
                part = pdf.iloc[a : a + 500].reset_index(drop=True)
                s = m.segments(part["_text"].tolist())
                if not len(s):
                    continue
                row, lang, n = s["row"].to_numpy(np.int64), s["lang"].to_numpy(np.int64), s["n"].to_numpy(float)
                amount = np.zeros((len(part), len(LANGS)))
                np.add.at(amount, (row, lang), n)
                longest = np.zeros((len(part), len(LANGS)))
                np.maximum.at(longest, (row, lang), n)
                sure = np.zeros((len(part), len(LANGS)))
                np.add.at(sure, (row, lang), n * s["margin"].to_numpy(float))
                at = np.unique(row)
                main = amount.argmax(1)[at]
                conf = m.confidence(sure[at, main] / amount[at, main])
                langs = [[LANGS[k] for k in range(len(LANGS)) if k == j or longest[i, k] >= MIN_WORDS - 1e-6] for i, j in zip(at, main)]
                yield pd.DataFrame({k: part[k].to_numpy()[at] for k in keys} | {"main": np.array(LANGS, object)[main], "confidence": conf, "n_words": amount[at].sum(1), "langs": langs})

    return df.select(*keys, F.col(text).alias("_text")).mapInPandas(run, schema)


def mislabelled(found: DataFrame, label: str) -> DataFrame:
    """``document_languages`` rows whose label is missing, a placeholder or wrong, or that hold several languages."""
    wrong = normal_label(F.col(label)).isNull() | (normal_label(F.col(label)) != F.col("main"))
    return found.filter(wrong | (F.size("langs") >= 2))
