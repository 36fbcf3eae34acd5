"""Problem 10: the subject areas of each document.

Class-association rules. The sentences of labelled samples are cut into
overlapping runs of ``RUN`` words (folded, so marks don't matter; Chinese by
character); each run is a transaction of its words with the subject as one more
item, and nothing is taken out of it but what the corpus shows to be set
phrases. Parallel frequent-pattern growth (``pyspark.ml.fpm.FPGrowth``) mines the
frequent sets; a set of up to ``MOST_ITEMS`` words with a subject gives a rule,
and a rule stays only if it is confident and no smaller rule for the subject is
about as confident (redundant rules are pruned after mining). Most syllables and
characters are in terms of several subjects, so most rules are sets. A sentence
sums the log odds of its matching rules, a temperature fitted on held-out
sentences turns the sums into probabilities, and a document has each subject
that at least a quarter of its sentences are about.

The samples are few, so the rules are mined twice: those of the samples label a
bounded sample of the corpus (``corpus_rows`` different texts, in an
order by hash), whose clear documents are mined again. That sample only says
which rules to ask about: how often each rule goes with each subject, and so its
confidence and weight, and in how many documents a word of the samples occurs,
are counted over all different texts of the corpus. Scoring is a map over the
corpus: nothing is shuffled, and the rules are bounded by ``max_rules``.

Defined results: null or empty texts, and texts without sentences, have no
subject; headings (lines without a final stop) aren't sentences; repeated rows
of a document give one row; ties go to the first subject by name.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiscript.llm.common import bounded_rows, bounded_sample, composed, folded

TOKENS = re.compile(r"[^\W\d_]+|[.!?…]+(?=\s|$)|[。！？]|\n")
HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿]")
MIN_WORDS, SHARE = 4, 0.25
#: Words of a transaction, and how far apart transactions begin: three neighbours are always together in one.
RUN, STEP = 5, 3
MOST_ITEMS = 3
#: Share of a language's documents from which a word of theirs belongs to set phrases.
SET_PHRASE = 0.35
#: One or two sentences that have less than this many rules for a subject only mention it in passing.
FIRM = 4
STOP, LINE = -1, -2
DIGITS, NUMERIC = frozenset("0123456789"), "0123456789.,/:%"
#: Entries of a table of word pairs that is held whole.
TABLE = 1 << 23


def sentences(text: str) -> list[list[str]]:
    """The sentences of a text as folded words; Han runs as characters; lines without a final stop left out."""
    out, own = [], []
    for t in TOKENS.findall(composed(text)):
        if t == "\n":
            own = []
        elif t[0].isalpha():
            w = folded(t)
            own += list(w) if HAN.search(w) else [w]
        else:
            if len(own) >= MIN_WORDS:
                out.append(own)
            own = []
    if len(own) >= MIN_WORDS and not (text or "").rstrip().endswith("\n") and "\n" not in (text or ""):
        out.append(own)
    return out


def runs(words: list[str]) -> list[list[str]]:
    """The distinct words of each run of a sentence; a run adds at least one word to the one before."""
    return [sorted({*words[a : a + RUN]}) for a in range(0, len(words), STEP) if a == 0 or a + RUN - STEP < len(words)]


def sentence_units(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sentence or line of each word number, the end of each, and whether it is a sentence."""
    end = ids < 0
    unit = np.r_[0, np.cumsum(end)[:-1]] if len(ids) else np.zeros(0, np.int64)
    stops = np.flatnonzero(end)
    size = np.diff(np.r_[-1, stops]) - 1
    return unit, stops, (ids[stops] == STOP) & (size >= MIN_WORDS)


def sorted_distinct(x: np.ndarray) -> np.ndarray:
    """The different numbers in order; ``np.unique`` hashes them one by one, which takes longer than to sort them."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


@dataclass
class SubjectModel:
    subjects: list[str]
    rules: list[tuple[tuple[str, ...], int, float]]  # words, subject, log odds
    scale: float = 1.0
    words: dict = field(default_factory=dict)
    memo: dict = field(default_factory=dict)
    flat: array = field(default_factory=lambda: array("q"))
    starts: array = field(default_factory=lambda: array("q"))
    lengths: array = field(default_factory=lambda: array("q"))

    def __getstate__(self):
        return {"subjects": self.subjects, "rules": self.rules, "scale": self.scale}

    def __setstate__(self, s):
        self.__init__(**s)

    def __post_init__(self):
        """Rules by body: singles by word number, pairs by two of them, triples by the number of their first pair and a third word."""
        for w in sorted({w for items, _, _ in self.rules for w in items}):
            self.words[w] = len(self.words) + 1
        size = len(self.words) + 1
        bodies: dict[tuple[int, ...], np.ndarray] = {}
        for items, subject, weight in self.rules:
            bodies.setdefault(tuple(sorted(self.words[w] for w in items)), np.zeros(len(self.subjects)))[subject] += weight
        self.bodies = sorted(bodies)
        self.weight = np.stack([bodies[b] for b in self.bodies]) if bodies else np.zeros((0, len(self.subjects)))
        place = {b: i for i, b in enumerate(self.bodies)}
        self.single = np.full(size, -1, np.int64)
        for b, i in place.items():
            if len(b) == 1:
                self.single[b[0]] = i
        firsts = sorted({b[:2] for b in self.bodies if len(b) >= 2})
        self.size = size
        self.pair_keys = np.array([a * size + b for a, b in firsts], np.int64)
        self.pair_rule = np.array([place.get(p, -1) for p in firsts], np.int64)
        number = {p: i for i, p in enumerate(firsts)}
        # Pairs by their two word numbers; a search where that table would be large.
        self.pair_at = None
        if size * size <= TABLE:
            self.pair_at = np.full(size * size, -1, np.int32)
            self.pair_at[self.pair_keys] = np.arange(len(firsts))
        self.begins = np.zeros(len(firsts), bool)
        triples = [b for b in self.bodies if len(b) == 3]
        self.begins[[number[b[:2]] for b in triples]] = True
        codes = np.array([number[b[:2]] * size + b[2] for b in triples], np.int64)
        order = np.argsort(codes)
        self.triple_keys, self.triple_rule = codes[order], np.array([place[b] for b in triples], np.int64)[order]
        # The weights of each body as a list: body after body.
        body, self.entry_subject = np.nonzero(self.weight)
        self.entry_weight = self.weight[body, self.entry_subject]
        self.entries = np.bincount(body, minlength=len(self.bodies))
        self.first_entry = np.cumsum(self.entries) - self.entries
        self.many = np.zeros(size, bool)  # words of sets
        self.many[[w for b in self.bodies if len(b) > 1 for w in b]] = True

    def chunk_numbers(self, chunk: str) -> tuple[int, ...]:
        out: tuple[int, ...] = ()
        for tok in TOKENS.findall(chunk):
            if tok == "\n":
                out += (LINE,)
            elif not tok[0].isalpha():
                out += (STOP,)
            else:
                w = folded(tok)
                out += tuple(self.words.get(x, 0) for x in (w if HAN.search(w) else [w]))
        return out

    def learned(self, chunk: str) -> int:
        """The place of a chunk's word numbers in ``flat``; nothing composes with a blank, so a chunk is composed by itself."""
        k = self.memo[chunk] = len(self.memo)
        own = self.chunk_numbers(composed(chunk))
        self.starts.append(len(self.flat))
        self.lengths.append(len(own))
        self.flat.extend(own)
        return k

    def numbers(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in a row (0: in no rule; STOP and LINE end a sentence) and the text of each.

        What stands between two blanks is looked at once; later it is looked up,
        once for all its occurrences in these texts.
        """
        if not self.memo or len(self.memo) > 300_000 or len(self.flat) > 3_000_000:
            self.memo, self.flat, self.starts, self.lengths = {".": 0, "\n": 1, "": 2}, array("q", [STOP, LINE]), array("q", [0, 1, 2]), array("q", [1, 1, 0])
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        chunks = parts.flatten().dictionary_encode()
        raw = chunks.dictionary.to_pylist()
        place = list(map(self.memo.get, raw))
        for i, c in enumerate(raw):
            if place[i] is None:
                # A number has no words, but may end a sentence.
                place[i] = (0 if c[-1] == "." else 2) if c[0] in DIGITS and not c.strip(NUMERIC) else self.learned(c)
        # After the chunks of each text comes its end: of a sentence, or of a line where the text has lines.
        n = len(texts)
        ends = np.cumsum(pc.list_value_length(parts).to_numpy()) + np.arange(n)
        at = np.empty(len(chunks) + n, np.int64)
        inside = np.ones(len(at), bool)
        inside[ends] = False
        at[inside] = np.array(place, np.int64)[chunks.indices.to_numpy()]
        at[ends] = pc.match_substring(texts, "\n").to_numpy(zero_copy_only=False)
        start, many = np.frombuffer(self.starts, np.int64)[at], np.frombuffer(self.lengths, np.int64)[at]
        total = np.cumsum(many)
        ids = np.frombuffer(self.flat, np.int64)[np.repeat(start - total + many, many) + np.arange(total[-1])]
        return ids, np.repeat(np.arange(n), np.diff(np.r_[0, total[ends]]))

    def matched(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The end of each sentence or line, whether it is a sentence, and the distinct (sentence, rule body) pairs."""
        end = ids < 0
        unit, stops, real = sentence_units(ids)
        none = np.zeros(0, np.int64)
        if not len(self.bodies) or not len(ids):
            return stops, real, none, none
        first = np.r_[0, stops[:-1] + 1]
        word = np.where(real[unit] & ~end, ids, 0)
        at = np.flatnonzero(word > 0)
        rule = self.single[word[at]]
        found = [(unit[at][rule >= 0], rule[rule >= 0])]
        if len(self.pair_keys):
            begin = np.flatnonzero(real[unit] & ~end & ((np.arange(len(ids)) - first[unit]) % STEP == 0))
            known = np.concatenate([np.where(self.many[np.maximum(word, 0)], word, 0), np.zeros(RUN, np.int64)])
            u = unit[begin]
            last = stops[u]
            w = np.stack([np.where(begin + j < last, known[begin + j], 0) for j in range(RUN)], 1).astype(np.int32 if self.pair_at is not None else np.int64)
            some = np.flatnonzero((w > 0).sum(1) >= 2)
            w, u = np.sort(w[some], 1), u[some]
            w[:, 1:][w[:, 1:] == w[:, :-1]] = 0
            for i, j in combinations(range(RUN), 2):
                both = np.flatnonzero((w[:, i] > 0) & (w[:, j] > 0))
                k = self.pair_number(w[both, i] * self.size + w[both, j])
                hit = k >= 0
                both, k = both[hit], k[hit]
                own = self.pair_rule[k] >= 0
                found.append((u[both][own], self.pair_rule[k][own]))
                if len(self.triple_keys) and j + 1 < RUN:
                    more = self.begins[k]
                    both, k = both[more], k[more]
                    for x in range(j + 1, RUN):
                        code = k * self.size + w[both, x]
                        t = np.minimum(np.searchsorted(self.triple_keys, code), len(self.triple_keys) - 1)
                        hit = (self.triple_keys[t] == code) & (w[both, x] > 0)
                        found.append((u[both][hit], self.triple_rule[t][hit]))
        n = len(self.bodies)
        pair = sorted_distinct(np.concatenate([a for a, _ in found]) * n + np.concatenate([b for _, b in found]))  # a rule counts once a sentence
        return stops, real, pair // n, pair % n

    def pair_number(self, code: np.ndarray) -> np.ndarray:
        if self.pair_at is not None:
            return self.pair_at[code].astype(np.int64)
        k = np.minimum(np.searchsorted(self.pair_keys, code), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[k] == code, k, -1)

    def weighed(self, u: np.ndarray, k: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The evidence of each of n sentences for each subject, and how many rules it has for it."""
        many = self.entries[k]
        at = np.repeat(self.first_entry[k] - np.cumsum(many) + many, many) + np.arange(many.sum())
        place = np.repeat(u, many) * len(self.subjects) + self.entry_subject[at]
        shape = (n, len(self.subjects))
        return np.bincount(place, self.entry_weight[at], n * shape[1]).reshape(shape), np.bincount(place, self.entry_weight[at] > 0, n * shape[1]).reshape(shape)

    def evidence(self, texts: list[str] | pa.Array, matches: bool = False) -> tuple[np.ndarray, ...]:
        """The text of each sentence and its evidence for each subject; with ``matches``, also how many rules for each subject it has."""
        ids, row = self.numbers(texts)
        stops, real, u, k = self.matched(ids)
        score, count = self.weighed(u, k, len(stops))
        return (row[stops][real], score[real]) if not matches else (row[stops][real], score[real], count[real])

    def probability(self, score: np.ndarray) -> np.ndarray:
        """Of each subject and, last, of none."""
        z = np.c_[score, np.full(len(score), 1.5)] * self.scale
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def clear_subjects(self, texts: list[str], share: float = SHARE) -> np.ndarray:
        """The subject that a text is clearly about, else -1; a text that repeats one phrase of a subject isn't clear."""
        ids, row = self.numbers(texts)
        return self.clear_matches(row, *self.matched(ids), len(texts), share)

    def clear_matches(self, row: np.ndarray, stops: np.ndarray, real: np.ndarray, u: np.ndarray, k: np.ndarray, texts: int, share: float = SHARE) -> np.ndarray:
        out = np.full(texts, -1, np.int64)
        if not len(self.bodies) or not len(stops):
            return out
        score, _ = self.weighed(u, k, len(stops))
        p = self.probability(score)[:, :-1]
        best, sure = p.argmax(1), p.max(1) * real
        text = row[stops]
        n = np.bincount(text[real], minlength=texts)
        mass = np.zeros((texts, len(self.subjects)))
        np.add.at(mass, (text, best), (sure > 0.6) * sure)
        top = mass.argmax(1)
        own = self.weight[k, top[text[u]]] > 0
        several = np.bincount(sorted_distinct(text[u][own] * len(self.bodies) + k[own]) // len(self.bodies), minlength=texts)
        high = mass.max(1)
        ok = (n >= 2) & (several >= 4) & (high >= share * n) & (high >= 4 * (mass.sum(1) - high))
        out[ok] = top[ok]
        return out


def per_text(corpus: DataFrame, model: SubjectModel, work, schema: str, text: str = "text", where: str = "true") -> DataFrame:
    """h and what ``work(model, texts)`` gives for the texts of each batch: one row for each different text that meets ``where``, which tells by the result."""
    bc = corpus.sparkSession.sparkContext.broadcast(model)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                yield pa.RecordBatch.from_arrays([part.column("h"), *map(pa.array, work(bc.value, part.column("_text")))], names=["h", *names])

    rows = corpus.select(F.xxhash64(text).alias("h"), F.col(text).alias("_text")).filter("_text IS NOT NULL").mapInArrow(run, f"h bigint, {schema}")
    return rows.filter(where).groupBy("h").agg(*[F.first(c).alias(c) for c in names])


def lists(text: np.ndarray, value: np.ndarray, n: int) -> pa.ListArray:
    """The values of each of n texts; ``text`` is in order."""
    return pa.ListArray.from_arrays(np.searchsorted(text, np.arange(n + 1)).astype(np.int32), value.astype(np.int32))


def text_spread(corpus: DataFrame, words: set[str], text: str = "text", most: int = 1_000_000) -> Counter:
    """In how many different texts of ``corpus`` each of the words occurs: a pass over all of them, in which copies count once."""
    names = sorted(words)
    if not names:
        return Counter()
    model = SubjectModel(["any"], [((w,), 0, 1.0) for w in names])

    def work(m, texts):
        ids, row = m.numbers(texts)
        unit, stops, real = sentence_units(ids)
        at = np.flatnonzero((ids > 0) & real[unit]) if len(ids) else unit
        seen = np.zeros((len(texts), m.size), bool)
        seen[row[at], ids[at]] = True
        text_no, word = np.nonzero(seen)
        return [lists(text_no, m.single[word], len(texts))]

    counts = per_text(corpus, model, work, "found array<int>", text).select(F.explode("found").alias("j")).groupBy("j").agg(F.count("*").alias("n"))
    return Counter({names[r.j]: r.n for r in bounded_rows(counts, most, "the words of the labelled sample")})


def transactions(labelled: DataFrame, drop: dict[str, set[str]] | None = None) -> DataFrame:
    """items: a row for each run of words of ``labelled`` (subject, text, lang), the subject among them; words of ``drop`` (by language) left out."""
    drop = drop or {}

    def run(batches):
        for pdf in batches:
            rows = []
            for s, t, x in zip(pdf["subject"], pdf["text"], pdf["lang"]):
                out = drop.get(x, ())
                rows += [["\0" + s, *own] for w in sentences(t) for r in runs(w) if (own := [i for i in r if i not in out])]
            yield pd.DataFrame({"items": pd.Series(rows, dtype=object)})

    return labelled.select("subject", "text", "lang").mapInPandas(run, "items array<string>")


def confidence(own, total, rest, others, classes: int):
    """Columns: (confidence, log odds) for balanced subjects, with a Laplace prior."""
    a, b = (own + 0.5) / (total + 1), (rest + 0.5) / (others + 1)
    return a / (a + (classes - 1) * b), F.log(a / b)


def pruned(odds: dict[tuple[tuple[str, ...], str], tuple[float, float]], max_rules: int) -> list[tuple[tuple[str, ...], str, float]]:
    """Rules without the redundant ones: those of which a smaller rule for the subject is about as confident."""
    kept: dict[tuple[tuple[str, ...], str], float] = {}
    for (body, subject), (conf, weight) in sorted(odds.items(), key=lambda x: (len(x[0][0]), x[0])):
        parts = (kept.get((p, subject)) for k in range(1, len(body)) for p in combinations(body, k))
        if not any(p is not None and p >= conf - 0.05 for p in parts):
            kept[body, subject] = conf
    if len(kept) > max_rules:
        raise ValueError(f"over {max_rules} rules")
    return [(body, subject, min(odds[body, subject][1], 6.0)) for body, subject in kept]


def mine(frame: DataFrame, min_count: int, min_conf: float, max_rules: int, partitions: int = 6) -> list[tuple[tuple[str, ...], str, float]]:
    """Rules from ``transactions``: frequent sets by FP-growth, confident ones kept, redundant ones pruned."""
    frame = frame.repartition(partitions).persist()
    n = frame.count()
    if not n:
        return []
    sets = FPGrowth(itemsCol="items", minSupport=min_count / n, minConfidence=0.0, numPartitions=partitions).fit(frame).freqItemsets
    label = F.filter("items", lambda i: i.startswith("\0"))
    sets = sets.select(F.sort_array(F.filter("items", lambda i: ~i.startswith("\0"))).alias("body"), F.substring(F.get(label, F.lit(0)), 2, 1000).alias("subject"), "freq").filter(F.size("body") <= MOST_ITEMS).persist()
    total = {r.subject: r.freq for r in bounded_rows(sets.filter("size(body) = 0"), 100_000, "the subjects")}
    own = sets.filter("subject IS NOT NULL AND size(body) > 0")
    both = own.join(sets.filter("subject IS NULL").select("body", F.col("freq").alias("every")), "body")
    of = F.element_at(F.create_map(*[F.lit(x) for p in total.items() for x in p]), F.col("subject")) if total else F.lit(0)
    conf, odds = confidence(F.col("freq"), of, F.col("every") - F.col("freq"), F.lit(n) - of, len(total))
    rows = bounded_rows(both.select("body", "subject", conf.alias("conf"), odds.alias("odds")).filter(F.col("conf") >= min_conf), 20 * max_rules, "the confident rules")
    frame.unpersist()
    sets.unpersist()
    return pruned({(tuple(r.body), r.subject): (r.conf, r.odds) for r in rows}, max_rules)


def recounted(corpus: DataFrame, model: SubjectModel, min_count: int, min_conf: float, max_rules: int, text: str = "text") -> SubjectModel:
    """The rules of ``model`` weighed anew by all different texts that it clearly gives a subject; those that don't hold there are left out."""

    def work(m, texts):
        ids, row = m.numbers(texts)
        stops, real, u, k = m.matched(ids)
        n = np.bincount(row[stops][real], minlength=len(texts))
        return m.clear_matches(row, stops, real, u, k, len(texts)).astype(np.int32), n.astype(np.int32), lists(row[stops][u], k, len(texts))

    seen = per_text(corpus, model, work, "s int, n int, found array<int>", text, "s >= 0")
    # One aggregate: of each subject the sentences (rule -1) and of each rule the sentences that have it.
    rows = seen.select("s", F.explode(F.concat(F.array_repeat(F.lit(-1), F.col("n")), "found")).alias("k")).groupBy("s", "k").agg(F.count("*").alias("n"))
    counts = np.zeros((len(model.subjects), len(model.bodies) + 1))
    for r in bounded_rows(rows, counts.size, "the counts of the rules"):
        counts[r.s, r.k] = r.n
    total, counts = counts[:, -1], counts[:, :-1]
    names = {v: w for w, v in model.words.items()}
    a = (counts + 0.5) / (total[:, None] + 1)
    b = (counts.sum(0) - counts + 0.5) / (total.sum() - total[:, None] + 1)
    conf = a / (a + (len(model.subjects) - 1) * b)
    odds = {}
    for i, body in enumerate(model.bodies):
        for s in np.flatnonzero((conf[:, i] >= min_conf) & (counts[:, i] >= min_count)):
            odds[tuple(sorted(names[w] for w in body)), model.subjects[s]] = (float(conf[s, i]), float(np.log(a[s, i] / b[s, i])))
    return rules_model(pruned(odds, max_rules), model.subjects, model.scale)


def rules_model(rules: list[tuple[tuple[str, ...], str, float]], subjects: list[str], scale: float = 1.0) -> SubjectModel:
    return SubjectModel(subjects, [(items, subjects.index(s), w) for items, s, w in rules], scale)


def fit_scale(model: SubjectModel, texts: list[str], labels: list[str]) -> float:
    """The temperature that makes held-out sentences likeliest."""
    row, score = model.evidence(texts)
    if not len(row):
        return 1.0
    y = np.array([model.subjects.index(labels[i]) for i in row])
    best = (-np.inf, 1.0)
    for scale in np.geomspace(0.1, 4, 30):
        model.scale = float(scale)
        p = model.probability(score)[np.arange(len(y)), y]
        best = max(best, (float(np.log(p + 1e-3).sum()), float(scale)))
    return best[1]


def fit_subjects(samples: DataFrame, corpus: DataFrame | None = None, corpus_rows: int = 2000, sample_rows: int = 20_000, max_rules: int = 40_000) -> SubjectModel:
    """Mines rules from ``samples`` (text, subject), then from at most ``corpus_rows`` different texts of ``corpus`` (text); their counts are those of all of it."""
    spark = samples.sparkSession
    lang = F.col("lang") if "lang" in samples.columns else F.lit("")
    known = bounded_rows(samples.select("text", "subject", F.coalesce(lang, F.lit("")).alias("lang")).filter("text IS NOT NULL AND subject IS NOT NULL").orderBy("subject", "lang", F.xxhash64("text")), sample_rows, "the labelled sample")
    subjects = sorted({r.subject for r in known})
    if not subjects:
        return SubjectModel([], [])
    # A language with few samples counts as much as the one with most, else its words are in no rule.
    of_lang = Counter(r.lang for r in known)
    times = {x: max(1, round(max(of_lang.values()) / n)) for x, n in of_lang.items()}

    def frame(rows: list[tuple[str, str, str]]) -> DataFrame:
        return spark.createDataFrame(rows, "subject string, text string, lang string").repartition(6)

    def seeds(rows) -> DataFrame:
        return frame([(r.subject, r.text, r.lang) for r in rows for _ in range(times[r.lang])])

    # Two occurrences: one gives a pair of neighbours in up to two runs.
    if corpus is None:
        held = [r for i, r in enumerate(known) if i % 5 == 4]
        model = rules_model(mine(transactions(seeds([r for i, r in enumerate(known) if i % 5 != 4])), 3, 0.55, max_rules), subjects)
        scale = fit_scale(model, [r.text for r in held], [r.subject for r in held])
        return rules_model(mine(transactions(seeds(known)), 3, 0.55, max_rules), subjects, scale)
    more = [r.text for r in bounded_sample(corpus.select("text"), "text", corpus_rows, "text IS NOT NULL", distinct=True)]
    # Words of a language's set phrases are in most of its documents, though few samples may have them; the first rules leave them out.
    own = {x: {i for r in known if r.lang == x for w in sentences(r.text) for i in w} for x in of_lang}
    spread = text_spread(corpus, set().union(*own.values()))
    usual: dict[str, set[str]] = {}
    for x, items in own.items():
        only = items.difference(*(v for k, v in own.items() if k != x))
        most = max((spread[i] for i in only or items), default=0)
        usual[x] = {i for i in items if spread[i] > SET_PHRASE * most}
    model = rules_model(mine(transactions(seeds(known), usual), 3, 0.55, max_rules), subjects)
    kept = []
    for lo in range(0, len(more), 500):
        part = more[lo : lo + 500]
        kept += [(subjects[s], t, "") for s, t in zip(model.clear_subjects(part), part) if s >= 0]  # all of its sentences count, so that set phrases spread over the subjects
    clear = [x for i, x in enumerate(kept) if i % 5 == 4]
    labelled = frame([*((r.subject, r.text, r.lang) for r in known), *(x for i, x in enumerate(kept) if i % 5 != 4)])
    found = mine(transactions(labelled), max(6, len(kept) // 400), 0.7, max_rules)
    # The rules of the samples stay candidates: of a rare language the corpus's sample may have little.
    new = {(items, s) for items, s, _ in found}
    model = rules_model([*found, *((items, subjects[s], w) for items, s, w in model.rules if (items, subjects[s]) not in new)], subjects)
    model.scale = fit_scale(model, [t for _, t, _ in clear], [s for s, _, _ in clear])
    model = recounted(corpus, model, 4, 0.88, max_rules)
    model.scale = fit_scale(model, [t for _, t, _ in clear], [s for s, _, _ in clear])
    return model


def document_subjects(df: DataFrame, model: SubjectModel, keys: list[str], text: str = "text", share: float = SHARE, cutoff: float = 0.4) -> DataFrame:
    """keys, subject, share of the sentences, score (mean probability): a row for each subject with at least ``share``."""
    bc = df.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", subject string, share double, score double, n_sentences bigint"

    def run(batches):
        m = bc.value
        k = len(m.subjects)
        for batch in batches:
            for a in range(0, len(batch) if k else 0, 500):
                part = batch.slice(a, 500)
                row, score, count = m.evidence(part.column("_text"), matches=True)
                p = m.probability(score)[:, :-1]
                best = p.argmax(1) if len(p) else np.zeros(0, np.int64)
                sure = p.max(1) >= cutoff if len(p) else np.zeros(0, bool)
                n = np.bincount(row, minlength=len(part))
                about = np.zeros((len(part), k))
                np.add.at(about, (row[sure], best[sure]), 1)
                firm = np.zeros((len(part), k))
                np.maximum.at(firm, (row[sure], best[sure]), count[np.flatnonzero(sure), best[sure]])
                mean = np.zeros((len(part), k))
                np.add.at(mean, row, p)
                d, s = np.nonzero((about > 0) & ((firm >= FIRM) | (about >= FIRM)) & (about >= share * n[:, None] - 1e-9))
                if len(d):
                    found = {"subject": pa.array(m.subjects, pa.string()).take(pa.array(s)), "share": pa.array(about[d, s] / n[d]), "score": pa.array(mean[d, s] / n[d]), "n_sentences": pa.array(n[d].astype(np.int64))}
                    yield pa.RecordBatch.from_pydict({c: part.column(c).take(pa.array(d)) for c in keys} | found)

    return df.select(*keys, F.col(text).alias("_text")).filter("_text IS NOT NULL").mapInArrow(run, schema)
