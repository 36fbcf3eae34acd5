"""Problem 4: noise in text from scanned pages.

One pass over the texts cuts them into lines and words and writes down what
needs the corpus to judge it: lines like headers and page numbers, words cut at
a line end, words with glyphs that scanning confuses, and counts of all words
(summed within each batch). Then, all by joins:

* skip-gram vectors are learned from the whole corpus (``Word2Vec``);
* a rare word is linked to the frequent words that plausible glyph edits, in any
  number, turn it into (a join on a spelling in which all glyphs that are taken
  for each other are equal), and each occurrence takes the candidate whose
  vector suits the vectors of its neighbours best; it is misread only where the
  candidate doesn't suit them clearly worse than any word of the corpus would;
* a word cut at a line end is joined where the whole is a known word and the
  hyphen isn't the word's own;
* a line is a running header where its form, digits aside, or its opening,
  comes back in several units (see ``header_lines``);
* a bare number is a page number unless the line before it is the label of a
  table, that is, a line that mostly has a number after it.

``repaired`` takes the furniture out, joins and corrects words, and reflows the
lines into paragraphs; only the repairs are grouped by unit, never the texts.

Defined results: null and blank texts have no noise and stay as they are;
repeated rows of a unit are found once; look-alike characters (problem 5) are
brought to the plain form first and are no misreading.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.ml.feature import Word2Vec
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiscript.llm.common import checkpointed
from lumiscript.llm.confusables import plain_text

# What a scanner reads for a letter, and the letter.
GLYPHS = (("rn", "m"), ("ri", "n"), ("li", "h"), ("cl", "đ"), ("cl", "d"), ("u'", "ư"), ("o'", "ơ"), ("e^", "ê"), ("o^", "ô"), ("a^", "â"), ("vv", "w"), ("ii", "u"), ("f", "t"), ("(", "c"), ("!", "i"), ("|", "l"), ("9", "g"), ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("8", "b"), ("$", "s"), ("€", "c"), ("¢", "c"))
SUSPECT = re.compile(r"rn|ri|li|cl|u'|o'|[eoa]\^|vv|ii|[f(!|$€¢]|[^\W\d_][015689]|[015689][^\W\d_]")
PAGE = re.compile(r"(?:trang|tr\.?|page|p\.)\s*(?:số\s*)?\d{1,4}(?:\s*/\s*\d{1,4})?|[-—–·•~*]\s*\d{1,4}\s*[-—–·•~*]|\[\s*\d{1,4}\s*\]|\(\s*\d{1,4}\s*\)|\d{1,4}\s*/\s*\d{1,4}", re.I)
BARE = re.compile(r"\d{1,4}")
SUFFIX = re.compile(r"(?:\s{2,}|\s*\|\s*|\s+[-–—]\s+(?:tr\.?|trang)\s*)\d{1,4}$|^\d{1,4}(?:\s{2,}|\s*\|\s*)", re.I)
HYPHEN = "-¬=‐‑\xad"
BROKEN = re.compile(rf"([^\W\d_]\S*)[{HYPHEN}]$")
LETTERS = re.compile(r"[^\W\d_]+")
EDGE = re.compile(r"^[\"“”'‘’\[{«]+|[.,;:?\"”’)\]}»…]+$")
MARKER = re.compile(r"\s*(?:\d{1,3}[.)]|[a-zđ]\)|[-•*+]\s|(?:điều|khoản|bước|chương|mục)\s+\d)", re.I)


def headline(line: str) -> tuple[str, bool, bool] | None:
    """(form, has a page number, is quiet) of a line that may be a header; else None.

    Loud ones are in capitals or have every word in one. A quiet one only begins
    with a capital, as lines of the text do; the corpus has to settle it.
    """
    body = SUFFIX.sub("", line)
    flat = re.sub(r"\s+", " ", body).strip()
    words = LETTERS.findall(re.sub(r"(?<=[^\W\d_])0|0(?=[^\W\d_])", "O", flat))
    n = sum(map(len, words))
    if len(words) < 2 or n < 4:
        return None
    loud = flat.upper() == flat
    title = all(w[0].isupper() and w[1:].lower() == w[1:] for w in words) and flat[-1] not in ".;,:" and (len(words) >= 4 or any(c.isdigit() for c in flat))
    quiet = not (loud or title)
    if quiet and not (flat[0].isupper() and len(words) >= 3 and flat[-1] not in ".;:,!?" + HYPHEN):
        return None
    form = re.sub(r"\d+", "#", re.sub(r"(?<=[^\W\d_])0|0(?=[^\W\d_])", "O", flat).upper())
    return form, body.strip() != line.strip(), quiet


def layout(text: str) -> list[tuple[str, str]]:
    """(kind, line) of each line: blank, page, bare, header (a loud one), text; the kinds are candidates."""
    out = []
    lines = text.split("\n")
    loud = sum(bool(x.strip()) and x.upper() == x for x in lines) > 0.5 * max(1, sum(bool(x.strip()) for x in lines))
    for line in lines:
        s = line.strip()
        if not s:
            out.append(("blank", line))
        elif PAGE.fullmatch(s):
            out.append(("page", s))
        elif BARE.fullmatch(s):
            out.append(("bare", s))
        elif not loud and (h := headline(s)) and not h[2]:
            out.append(("header", s))
        else:
            out.append(("text", line))
    return out


def label_form(line: str) -> str:
    return re.sub(r"\d+", "#", line.strip().lower())


def word_key(token: str) -> str:
    return EDGE.sub("", token).strip("(!").lower()


def read_text(text: str, words: Counter, labels: Counter, followed: Counter) -> list[tuple]:
    """Notes on one text: (kind, a, b, context); adds to the counts of the corpus."""
    notes = []
    lines = layout(plain_text(text))
    flow: list[tuple[str, bool]] = []  # tokens in reading order; True: joined over a line end
    open_part, spaced = "", False
    waited: int = 0
    passed: list[tuple[str, bool]] = []
    last = ""
    for kind, line in lines:
        if kind == "blank":
            continue
        if kind == "page":
            notes.append(("page", line, None, None))
            continue
        if kind == "bare":
            form = label_form(last)
            if len(form.split()) <= 6:
                followed[form] += 1
                notes.append(("bare", line, form, None))
            else:
                notes.append(("page", line, None, None))
            last = line
            continue
        if kind == "header":
            form, paged, _ = headline(line)
            notes.append(("header", form, "paged" if paged else None, None))
            notes += [("odd", w.lower(), None, []) for w in line.split() if SUSPECT.search(w.lower()) and LETTERS.search(w)]
            continue
        tokens = line.split()
        h = headline(line.strip())
        if h and h[2]:
            notes.append(("quiet", h[0], "paged" if h[1] else None, None))
        if len(tokens) <= 6:
            labels[label_form(line)] += 1
        last = line
        if open_part and tokens:
            right = tokens[0]
            if h and h[2] and waited < 2:  # it may be a header inside the cut word
                waited += 1
                passed += [(t, False) for t in tokens]
                continue
            if right[0].isalpha() and right[0].islower():
                notes.append(("break", open_part[:-1].lower(), word_key(right), ["gap" if spaced or waited else open_part[-1]]))
                flow[-1] = (open_part[:-1] + right, True)
                tokens = tokens[1:]
            open_part = ""
        flow += passed
        waited, passed = 0, []
        flow += [(t, False) for t in tokens]
        spaced = len(tokens) > 1 and len(tokens[-1]) == 1 and tokens[-1] in HYPHEN and tokens[-2][-1].isalpha()
        if spaced:  # a gap before the hyphen
            flow.pop()
            flow[-1] = (flow[-1][0] + tokens[-1], False)
        if tokens and (spaced or BROKEN.search(line.rstrip())):
            open_part = flow[-1][0]
            left = LETTERS.findall(open_part[:-1])
            if not left or open_part[:-1].isupper() and len(open_part) > 2:
                open_part = ""
    flow += passed
    keys = [word_key(t) for t, _ in flow]
    for (t, joined), k in zip(flow, keys):
        if not joined and k:
            words[k] += 1
    for i, (t, _) in enumerate(flow):
        raw = EDGE.sub("", t).lower()
        if SUSPECT.search(raw) and LETTERS.search(raw):
            notes.append(("odd", raw, None, [k for k in keys[max(0, i - 3) : i] + keys[i + 1 : i + 4] if k]))
    return notes


def scan_notes(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, kind, a, b, context, n: the notes of all texts and the counts of the corpus (with null keys)."""
    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for pdf in batches:
            words, labels, followed = Counter(), Counter(), Counter()
            rows = []
            for key, t in zip(pdf[keys].itertuples(index=False, name=None), pdf["_text"]):
                seen = set()
                for note in read_text(t, words, labels, followed):
                    mark = note[:3] + (tuple(note[3]) if note[3] else None,)
                    if mark not in seen:  # once a text
                        seen.add(mark)
                        rows.append((*key, *note, 1))
            nobody = tuple([None] * len(keys))
            for kind, counts in (("word", words), ("label", labels), ("followed", followed)):
                rows += [(*nobody, kind, a, None, None, n) for a, n in counts.items()]
            yield pd.DataFrame(rows, columns=[*keys, "kind", "a", "b", "context", "n"])

    rows = df.select(*keys, F.col(text).alias("_text")).filter("_text IS NOT NULL").distinct()
    return rows.mapInPandas(run, f"{types}, kind string, a string, b string, context array<string>, n bigint")


def glyph_classes() -> dict[str, str]:
    """Each character's spelling in the least glyphs: two texts are spelt alike where glyph edits lead from one to the other."""
    same: dict[str, str] = {}

    def top(c: str) -> str:
        while c in same:
            c = same[c]
        return c

    for wrong, right in GLYPHS:
        if len(wrong) == 1 and top(wrong) != top(right):
            same[top(wrong)] = top(right)
    parts = {top(right): wrong for wrong, right in GLYPHS if len(wrong) == 2}

    def spelt(c: str) -> str:
        c = top(c)
        return "".join(map(spelt, parts[c])) if c in parts else c

    return {c: spelt(c) for c in {x for pair in GLYPHS for part in pair for x in part}}


SPELLING = str.maketrans(glyph_classes())


def glyph_edits(token: str, word: str) -> int | None:
    """The least number of glyphs read wrongly that makes ``token`` of ``word``; null where none does."""
    best: dict[tuple[int, int], int] = {(0, 0): 0}
    for i in range(len(token)):
        for j in range(len(word)):
            if (n := best.get((i, j))) is None:
                continue
            steps = [(i + 1, j + 1, n)] if token[i] == word[j] else []
            steps += [(i + len(wrong), j + 1, n + 1) for wrong, right in GLYPHS if right == word[j] and token.startswith(wrong, i)]
            for a, b, m in steps:
                best[a, b] = min(best.get((a, b), m), m)
    return best.get((len(token), len(word)))


def glyph_links(notes: DataFrame, vocabulary: DataFrame, least: int = 10, ratio: int = 20) -> DataFrame:
    """token, word, word_n, edits: rare tokens and the frequent words that glyph edits make of them."""

    def spelt(c: str):
        def run(batches):
            for pdf in batches:
                yield pdf.assign(spelling=[t.translate(SPELLING) for t in pdf[c]])

        return run

    def verify(batches):
        for pdf in batches:
            yield pdf.assign(edits=pd.array([glyph_edits(t, w) for t, w in zip(pdf["token"], pdf["word"])], "Int32"))[["token", "word", "word_n", "edits"]]

    own = vocabulary.select(F.col("w").alias("token"), F.col("n").alias("token_n"))
    tokens = notes.filter("kind = 'odd'").select(F.col("a").alias("token")).distinct().join(own, "token", "left").select("token", F.coalesce("token_n", F.lit(0)).alias("token_n"))
    frequent = vocabulary.filter(F.col("n") >= least).select(F.col("w").alias("word"), F.col("n").alias("word_n")).filter(F.col("word").rlike(r"^[\p{L}\p{M}]+$"))
    pairs = tokens.mapInPandas(spelt("token"), "token string, token_n bigint, spelling string").join(frequent.mapInPandas(spelt("word"), "word string, word_n bigint, spelling string"), "spelling")
    pairs = pairs.filter((F.col("word_n") >= ratio * F.col("token_n")) & (F.col("token") != F.col("word"))).select("token", "word", "word_n")
    return pairs.mapInPandas(verify, "token string, word string, word_n bigint, edits int").filter("edits IS NOT NULL")


def skip_gram(df: DataFrame, text: str, vocabulary: DataFrame, size: int = 16, least: int = 20, max_vectors: int = 300_000) -> DataFrame:
    """w, vector: skip-gram vectors of the frequent words, learned from all texts, about the mean vector and of length 1.

    The vocabulary and its vectors are held by the driver, so ``max_vectors`` bounds them (40 MB); beyond it this raises.
    """
    spark = df.sparkSession
    r = vocabulary.filter((F.col("n") >= least) & F.col("w").rlike(r"^\p{L}+$")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).first()
    if not r.words:  # the fit would fail on a corpus without a frequent word
        return spark.createDataFrame([], "w string, vector array<double>")
    if r.words > max_vectors:
        raise ValueError(f"over {max_vectors} words occur {least} times")
    words = F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{M}\s]+", " ")), r"\s+"), lambda w: w != "")
    rows = df.select(words.alias("words")).filter(F.size("words") > 1)
    parts = max(1, min(64, spark.sparkContext.defaultParallelism), r.n // 2_000_000)
    found = Word2Vec(inputCol="words", outputCol="v", vectorSize=size, windowSize=3, minCount=least, maxIter=1, numPartitions=parts, seed=11).fit(rows).getVectors().collect()
    v = np.array([x.vector.toArray() for x in found])
    v -= v.mean(0)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return spark.createDataFrame([(x.word, y.tolist()) for x, y in zip(found, v)], "w string, vector array<double>")


def corrections(notes: DataFrame, links: DataFrame, vectors: DataFrame, keys: list[str], agree: float = -0.17) -> DataFrame:
    """keys, token, word: for each misread token of a unit the candidate that suits its context best, unless its context speaks against it.

    ``agree`` is the mean cosine with six neighbours that a word taken at random,
    whose vectors are about the mean, falls short of once in twenty times. A token whose candidate or neighbours have no vector has no context to speak
    against it; the fewest edits and the most frequent candidate decide then.
    """
    odd = notes.filter("kind = 'odd'").select(*keys, F.col("a").alias("token"), F.coalesce("context", F.array().cast("array<string>")).alias("context"))
    near = odd.join(links, "token").select(*keys, "token", "word", "word_n", "edits", F.explode_outer("context").alias("c"))
    v = vectors.select("w", "vector")
    near = near.join(v.select(F.col("w").alias("word"), F.col("vector").alias("wv")), "word", "left").join(v.select(F.col("w").alias("c"), F.col("vector").alias("cv")), "c", "left")
    cosine = F.aggregate(F.zip_with("wv", "cv", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = near.groupBy(*keys, "token", "word", "word_n", "edits").agg(F.avg(cosine).alias("score"))
    best = scored.groupBy(*keys, "token").agg(F.max_by(F.struct("word", "score"), F.struct(F.coalesce("score", F.lit(0.0)), -F.col("edits"), "word_n", "word")).alias("best"))
    return best.select(*keys, "token", "best.word", "best.score").filter(F.col("score").isNull() | (F.col("score") >= agree)).drop("score")


def header_lines(notes: DataFrame, keys: list[str], least: int) -> DataFrame:
    """keys, form, paged: the running headers.

    A loud line is one where its form or its opening (two words) is that of
    loud lines in ``least`` units. A quiet line is one where its form is that of
    such a loud line, or where it has no number, its opening is theirs, and its
    form comes back in as many units or has a page number.
    """
    rows = notes.filter(F.col("kind").isin("header", "quiet")).select(*keys, "kind", F.col("a").alias("form"), F.col("b").alias("paged"), F.concat_ws(" ", F.slice(F.split("a", " "), 1, 2)).alias("opening")).distinct()
    count = lambda kind, c, to: rows.filter(F.col("kind").isin(*kind)).select(*keys, c).distinct().groupBy(c).agg(F.count("*").alias(to)).filter(F.col(to) >= least)
    rows = rows.join(count(("header",), "form", "n_loud"), "form", "left").join(count(("header", "quiet"), "form", "n_form"), "form", "left").join(count(("header",), "opening", "n_opening"), "opening", "left")
    loud = F.col("n_loud").isNotNull() | F.col("n_opening").isNotNull()
    quiet = F.col("n_loud").isNotNull() | (F.col("n_opening").isNotNull() & ~F.contains("form", F.lit("#")) & (F.col("n_form").isNotNull() | F.col("paged").isNotNull()))
    return rows.filter(F.when(F.col("kind") == "header", loud).otherwise(quiet)).select(*keys, "form", "paged").distinct()


def noise(df: DataFrame, keys: list[str], text: str = "text", least: int = 3) -> dict[str, DataFrame]:
    """Tables of the noise by kind, each with the keys and what was found; built on notes that are written down once."""
    notes = checkpointed(scan_notes(df, keys, text))
    vocabulary = notes.filter("kind = 'word'").groupBy(F.col("a").alias("w")).agg(F.sum("n").alias("n"))
    known = vocabulary.filter(F.col("n") >= least).select("w", "n")
    # Words cut at a line end.
    cut = notes.filter("kind = 'break'").select(*keys, F.col("a").alias("l"), F.col("b").alias("r"), F.element_at("context", 1).alias("h"))
    cut = cut.withColumn("whole", F.concat("l", "r"))
    named = lambda c, to: known.select(F.col("w").alias(c), F.col("n").alias(to))
    cut = cut.join(named("whole", "n_whole"), "whole", "left").join(named("l", "n_l"), "l", "left").join(named("r", "n_r"), "r", "left")
    own = known.select(F.split("w", "-").alias("p")).filter(F.size("p") == 2).select(F.get("p", F.lit(0)).alias("l"), F.get("p", F.lit(1)).alias("r"), F.lit(True).alias("hyphened"))
    cut = cut.join(own, ["l", "r"], "left")
    # Without the whole in the vocabulary: a cut where a part is no word, as in a misread word.
    joined = F.col("n_whole").isNotNull() | (F.col("h") != "gap") & (F.col("n_l").isNull() | F.col("n_r").isNull())
    breaks = cut.filter(joined & F.col("hyphened").isNull()).select(*keys, "l", "r", "h").distinct()
    # Furniture.
    headers = header_lines(notes, keys, least)
    count = lambda kind, to: notes.filter(F.col("kind") == kind).groupBy(F.col("a").alias("form")).agg(F.sum("n").alias(to))
    tables = count("followed", "n_f").join(count("label", "n_l"), "form", "left").filter((F.col("n_f") >= least) & (2 * F.col("n_f") >= F.coalesce("n_l", F.lit(0)))).select("form")
    bare = notes.filter("kind = 'bare'").select(*keys, F.col("a").alias("line"), F.col("b").alias("form")).join(tables, "form", "left_anti").select(*keys, "line")
    pages = notes.filter("kind = 'page'").select(*keys, F.col("a").alias("line")).unionByName(bare).distinct()
    # Misread words.
    fixes = corrections(notes, glyph_links(notes, vocabulary), skip_gram(df, text, vocabulary), keys)
    return {"breaks": breaks, "headers": headers, "pages": pages, "fixes": fixes}


def noise_kinds(found: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """keys, kind: each kind of noise once for each unit."""
    kind = lambda df, k: df.select(*keys, F.lit(k).alias("kind"))
    parts = [kind(found["breaks"], "hyphen_break"), kind(found["headers"], "running_header"), kind(found["pages"], "page_number"), kind(found["headers"].filter("paged IS NOT NULL"), "page_number"), kind(found["fixes"], "misread")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def reflowed(text: str, breaks: set, headers: set, pages: list, fixes: dict) -> str:
    """One text repaired: furniture out, cut words joined, misread words corrected, lines flowed into paragraphs."""
    left = Counter(pages)
    kept: list[str] = []
    for kind, line in layout(plain_text(text)):
        s = line.strip()
        if kind in ("header", "text") and headers and (h := headline(s)) and h[0] in headers:
            continue
        if kind in ("page", "bare") and left[s] > 0:
            left[s] -= kind == "bare"
            continue
        if kind == "blank":
            continue
        kept.append(re.sub(r"\s+", " ", s))
    out: list[str] = []
    for line in kept:
        if out:
            prev = out[-1]
            if len(prev) > 2 and prev[-2] == " " and prev[-1] in HYPHEN:
                prev = prev[:-2] + prev[-1]
            head, tail = prev.split(" ")[-1], line.split(" ")[0]
            if head[-1:] in HYPHEN and (head[:-1].lower(), word_key(tail)) in breaks:
                out[-1] = prev[:-1] + line
                continue
            if not MARKER.match(line) and prev[-1] not in ".;:!?" and (line[0].islower() or line[0].isdigit() and len(prev) > 40 or len(prev) > 50):
                out[-1] = prev + " " + line
                continue
        out.append(line)

    def fix(t: str) -> str:
        raw = EDGE.sub("", t)
        word = fixes.get(raw.lower())
        if not word:
            return t
        word = word.upper() if raw.isupper() and len(raw) > 1 else word[0].upper() + word[1:] if raw[:1].isupper() else word
        return t.replace(raw, word, 1)

    return "\n".join(" ".join(fix(t) for t in line.split(" ")) for line in out)


def repaired(df: DataFrame, found: dict[str, DataFrame], keys: list[str], text: str = "text") -> DataFrame:
    """keys, text: each distinct row of ``df`` repaired; texts without noise are only reflowed."""
    group = lambda d, *agg: d.groupBy(*keys).agg(*agg)
    b = group(found["breaks"], F.collect_set(F.concat_ws("\n", "l", "r")).alias("_b"))
    h = group(found["headers"], F.collect_set("form").alias("_h"))
    p = group(found["pages"], F.collect_list("line").alias("_p"))
    f = group(found["fixes"], F.map_from_entries(F.collect_list(F.struct("token", "word"))).alias("_f"))
    rows = df.select(*keys, F.col(text).alias("_text")).distinct()
    for x in (b, h, p, f):
        rows = rows.join(x, keys, "left")
    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for pdf in batches:
            texts = []
            for t, b, h, p, f in zip(pdf["_text"], pdf["_b"], pdf["_h"], pdf["_p"], pdf["_f"]):
                none = lambda x: x is None
                texts.append(t if not t or not t.strip() else reflowed(t, set() if none(b) else {tuple(x.split("\n")) for x in b}, set() if none(h) else {*h}, [] if none(p) else [*p], {} if none(f) else dict(f)))
            yield pdf[keys].assign(**{text: texts})

    return rows.mapInPandas(run, f"{types}, {text} string")
