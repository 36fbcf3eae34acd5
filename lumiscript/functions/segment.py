"""Splitting of glued Vietnamese words into syllables.

The cheapest split of a word is a shortest path over its letters. It is found for
many words at once: the prices of all pieces are one array (each different piece
is priced once), and one pass over the positions settles a position of every
word together. Only texts that are glued at all leave the JVM. The known
syllables are learned from clean texts; a list of the caller's may be added.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiscript.functions import text as T

PATTERN = re.compile(T.SYLLABLE, re.IGNORECASE)
WORD = re.compile(r"[^\W\d_]+")
MAX = T.MAX_SYLLABLE
# The price of a known syllable, of a valid one, of another piece (and of each of its letters).
KNOWN, VALID, OTHER = 1.0, 4.0, 15.0


def valid_pieces(pieces: pd.Series) -> np.ndarray:
    return (pieces.str.len() <= MAX).to_numpy() & pieces.map(lambda x: PATTERN.match(x) is not None).to_numpy(bool)


def prices(pieces: np.ndarray, known: frozenset[str]) -> np.ndarray:
    """The price of each piece; each different one is looked at once."""
    number, names = pd.factorize(pieces)
    low = pd.Series(names, dtype=object).str.lower()
    price = np.where(low.isin(known), KNOWN, np.where(valid_pieces(low), VALID, OTHER + low.str.len()))
    return price.astype(float)[number]


def splits(tokens: list[str], known: frozenset[str], block: int = 2000) -> dict[str, list[str]]:
    """The cheapest split of each token into pieces of at most ``MAX`` letters; of equal ones that with the shortest last piece."""
    out: dict[str, list[str]] = {}
    tokens = sorted({*tokens} - {""}, key=lambda t: (len(t), t))  # words of a block are about as long
    for a in range(0, len(tokens), block):
        part = tokens[a : a + block]
        n, longest = len(part), len(part[-1])
        at = [(i, end, size) for i, t in enumerate(part) for end in range(1, len(t) + 1) for size in range(1, min(MAX, end) + 1)]
        i, end, size = np.array(at).T
        price = np.full((n, longest + 1, MAX), np.inf)
        price[i, end, size - 1] = prices(np.array([part[x][y - z : y] for x, y, z in at], dtype=object), known)
        # Columns to the left of the first letter can't be reached.
        total = np.full((n, MAX + longest + 1), np.inf)
        total[:, MAX] = 0.0
        last = np.zeros((n, longest + 1), np.int64)
        for e in range(1, longest + 1):
            way = total[:, MAX + e - 1 : e - 1 : -1] + price[:, e]
            last[:, e] = way.argmin(1) + 1
            total[:, MAX + e] = way.min(1)
        for row, t in enumerate(part):
            cuts = [len(t)]
            while cuts[-1]:
                cuts.append(cuts[-1] - int(last[row, cuts[-1]]))
            out[t] = [t[x:y] for y, x in zip(cuts[:-1], cuts[1:])][::-1]
    return out


def kept_words(words: pd.Series, known: frozenset[str]) -> np.ndarray:
    """Words that stay as they are: known ones, and valid ones of up to four letters."""
    low = words.str.lower()
    return low.isin(known).to_numpy() | (valid_pieces(low) & (words.str.len() <= 4).to_numpy())


def separated(texts: pd.Series, known: frozenset[str]) -> pd.Series:
    """The texts with each glued word split; the words of the whole batch are split together."""
    words = pd.Series(sorted({w for t in texts.dropna() for w in WORD.findall(t)}), dtype=object)
    if not len(words):
        return texts
    new = {w: " ".join(x) for w, x in splits(words[~kept_words(words, known)].tolist(), known).items()}
    return texts.map(lambda t: WORD.sub(lambda m: new.get(m[0], m[0]), t) if isinstance(t, str) else t)


def syllables(texts: DataFrame, text: str = "text", seed: list[str] | None = None, most: int = 50_000) -> frozenset[str]:
    """The valid syllables of clean texts and of ``seed``; their number is bounded by what a syllable can be, and checked."""
    w = texts.select(F.explode(T.words(F.lower(F.col(text)))).alias("w")).filter(T.is_syllable(F.col("w"))).distinct().limit(most + 1).collect()
    if len(w) > most:
        raise ValueError(f"over {most} syllables")
    return frozenset([r.w for r in w] + [s.lower() for s in seed or []])


def desegmented(texts: DataFrame, known: frozenset[str], text: str = "text", least: float = 0.25) -> DataFrame:
    """Replaces ``text`` where its share of odd words is at least ``least``; adds glue_before and glue_after."""
    bc = texts.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("string")
    def fix(s: pd.Series) -> pd.Series:
        return separated(s, bc.value)

    rows = texts.withColumn("glue_before", T.glue_ratio(F.col(text)))
    glued = F.coalesce(F.col("glue_before") >= least, F.lit(False))
    fixed = rows.filter(glued).withColumn(text, fix(text)).withColumn("glue_after", T.glue_ratio(F.col(text)))
    return rows.filter(~glued).withColumn("glue_after", F.col("glue_before")).unionByName(fixed)
