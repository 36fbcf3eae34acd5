"""Problem 3: the share of repeated content inside each text.

One pass over each text marks the words that are copies: of a sentence, line or
paragraph that occurs at least three times (all but the first), and of a word
or phrase repeated at length back to back. Case, punctuation, list numbers and
look-alike characters don't make copies different. The share of the marked words, and other measures of repetition,
vote as labelling functions or abstain; expectation-maximization estimates how
right each is (see ``weak``), and the posterior, not a row of thresholds that
all must pass, says whether a text is repetitive.

The marking is a map without a shuffle. Every period up to a third of the text
counts: those up to ``SHORT_PERIOD`` words are compared word by word, a longer
one only where runs of words at its multiples are equal.

Defined results: null and empty texts have no words, share 0 and no vote;
repeated rows are measured once per row.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiscript.llm.confusables import plain_text
from lumiscript.llm.weak import fit_label_model

SHORT_PERIOD, TIMES, SHARE = 60, 3, 0.2
LIST_NUMBER = re.compile(r"^\s*(?:\(?\d{1,3}\s*[.):\]]|[-•*+–·]|\(?[a-zđ]\)|(?:bước|buoc|step)\s*\d+\s*[:.)])\s*")
UNIT = re.compile(r"(?<=[.!?…;])\s+|(?<=[。！？；])")
WORD = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+(?:[.,/]\d+)*")
MEASURES = ["n_words", "copy_words", "sentence_share", "line_share", "paragraph_share", "phrase_share", "repeat_share", "ngram_share", "zipped", "distinct_pairs"]


def run_hashes(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 words from each place on, by doubling."""
    h = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        for step in (1, 2, 4, 8, 16):
            h = (h[:-step] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[:-step] >> np.uint64(29)) ^ (h[step:] * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(step))
    return h


def back_to_back(ids: np.ndarray, least: int = 6) -> np.ndarray:
    """Marks the words after the first of a word or phrase repeated back to back at least twice more, over ``least`` words."""
    n = len(ids)
    out = np.zeros(n, bool)
    # Where a place lies in a repeat, the end of that repeat less its period.
    within = np.zeros(n, np.int64)

    def mark(p: int) -> None:
        same = ids[p:] == ids[:-p]
        if np.count_nonzero(same) < max(least, (TIMES - 1) * p):
            return
        edge = np.diff(np.concatenate([[0], same.view(np.int8), [0]]))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        for a, b in zip(start, end):
            if b - a >= max(least, (TIMES - 1) * p):
                out[a + p : b + p] = True
                np.maximum(within[a : b + p], b, out=within[a : b + p])

    for p in range(1, min(SHORT_PERIOD, n // 2) + 1):
        mark(p)
    if n // TIMES > SHORT_PERIOD:
        h = run_hashes(ids)
        for p in range(SHORT_PERIOD + 1, n // TIMES + 1):
            # A repeat of the period has a multiple of it in its first copy, and there a run of words equals the next one.
            own = h[::p]
            at = np.flatnonzero(own[1:] == own[:-1])
            # What shares a period and more with a repeat of a shorter one is part of a repeat that is marked.
            if len(at) and (within[at * p] < at * p + p).any():
                mark(p)
    return out


def measure(text: str | None) -> tuple:
    """The values of ``MEASURES`` for a text."""
    t = plain_text(text).lower() if text else ""
    lines = t.split("\n")
    words: list[str] = []
    marks = {"sentence": [], "line": [], "paragraph": []}  # (start, end) of each unit
    para = 0
    for line in lines:
        if not line.strip():
            if len(words) > para:
                marks["paragraph"].append((para, len(words)))
            para = len(words)
            continue
        a = len(words)
        for part in UNIT.split(LIST_NUMBER.sub("", line)):
            b = len(words)
            words += WORD.findall(part)
            if len(words) > b:
                marks["sentence"].append((b, len(words)))
        if len(words) > a:
            marks["line"].append((a, len(words)))
    if len(words) > para:
        marks["paragraph"].append((para, len(words)))
    n = len(words)
    if not n:
        return (0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None, None)
    number: dict[str, int] = {}
    flat = [number.setdefault(w, len(number)) for w in words]
    ids = np.array(flat, np.int64)
    copy = np.zeros(n, bool)
    share = {}
    for kind, units in marks.items():
        own = np.zeros(n, bool)
        if len(units) >= TIMES:
            keys = [tuple(words[a:b]) for a, b in units]
            count, seen = Counter(keys), set()
            for (a, b), k in zip(units, keys):
                if count[k] >= TIMES:
                    if k in seen:
                        own[a:b] = True
                    seen.add(k)
        share[kind] = own.sum() / n
        copy |= own
    phrase = back_to_back(ids)
    copy |= phrase
    grams = Counter(zip(flat, flat[1:], flat[2:], flat[3:], flat[4:])) if n >= 10 else {}
    raw = t.encode("utf-8", "surrogatepass")
    zipped = len(zlib.compress(raw, 6)) / len(raw) if len(raw) >= 200 else None
    pairs = len({*zip(flat, flat[1:])}) / (n - 1) if n >= 20 else None
    return (n, int(copy.sum()), share["sentence"], share["line"], share["paragraph"], phrase.sum() / n, copy.sum() / n, max(grams.values()) / (n - 4) if grams else 0.0, zipped, pairs)


def repetition_measures(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", n_words bigint, copy_words bigint, " + ", ".join(f"{m} double" for m in MEASURES[2:])

    def run(batches):
        for pdf in batches:
            found = pd.DataFrame([measure(t) for t in pdf.pop("_text")], columns=MEASURES)
            yield pd.concat([pdf.reset_index(drop=True), found], axis=1)

    return df.select(*keys, F.col(text).alias("_text")).mapInPandas(run, schema)


def with_votes(m: DataFrame) -> DataFrame:
    """The labelling functions: each votes at clear values of its own measure and abstains between; none sees the share of all copies."""

    def vote(value: str, high: float, low: float):
        return F.when(F.col(value) >= high, 1).when(F.col(value) <= low, 0)

    return m.withColumns({
        "v_sentence": vote("sentence_share", SHARE, 0.0),
        "v_line": vote("line_share", SHARE, 0.0),
        "v_paragraph": vote("paragraph_share", SHARE, 0.0),
        "v_phrase": vote("phrase_share", SHARE, 0.0),
        "v_ngram": F.when(F.col("n_words") >= 50, vote("ngram_share", 0.08, 0.015)),  # in a short text one gram twice is a large share
        "v_zipped": F.when(F.col("zipped") <= 0.3, 1).when(F.col("zipped") >= 0.42, 0),
        "v_pairs": F.when(F.col("distinct_pairs") <= 0.6, 1).when(F.col("distinct_pairs") >= 0.88, 0),
    })


VOTES = ["v_sentence", "v_line", "v_paragraph", "v_phrase", "v_ngram", "v_zipped", "v_pairs"]


def repetitive(measures: DataFrame, prior: float = 0.1) -> DataFrame:
    """``measures`` (written down, as it is read twice) with the posterior of being repetitive."""
    voted = with_votes(measures)
    model = fit_label_model(voted.filter("n_words > 0"), VOTES, prior)
    return voted.withColumn("repetitive", F.when(F.col("n_words") > 0, model.posterior()).otherwise(0.0))
