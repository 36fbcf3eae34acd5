"""Problem 9: passages of held-out test items inside the corpus.

Pigeonhole edit matching on words. A leak is a running part of at least
``PART`` words of an item (all of it if the item is shorter) that a document
holds apart from case, diacritics, punctuation, spacing and one edited word in
``ONE_IN``, so longer parts have more edits. With a budget of e edits, a part
split into e + 1 pieces has one piece that occurs exactly, wherever the part
begins; so all pieces of every item are looked up exactly, and each exact hit is
verified by Myers' bit-parallel edit distance to both sides of it, for many hits
at once. Of a leak of twice the least length or more, one half is a leak by
itself, so only parts below that length are verified.

The items are held-out test sets, of a size that is checked (``item_rows``);
beyond that they are matched in blocks, each block against all documents. The
documents are only mapped over: nothing is shuffled, however hot a document.

Defined results: null or empty texts and items leak nothing; repeated rows of
a document or an item give one row; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiscript.llm.common import bounded_rows, folded

PART, ONE_IN = 28, 9
#: Words to one side of a hit that a bit-parallel column has room for.
WIDEST = 64
#: Hits that are held at once, about; the texts of a block are verified together.
HELD = 2_000_000
DROP = re.compile(r"[^\w\s]+|_")


def word_list(text: str | None) -> list[str]:
    return DROP.sub("", folded(text)).split() if text else []


def needs(n: int, part: int = PART, one_in: int = ONE_IN) -> tuple[int, int, int]:
    """The least and the greatest number of words of a part to verify, and the length of a piece, for an item of n words."""
    need = min(n, part)
    most = min(n, 2 * need - 1)
    return need, most, min(x // (x // one_in + 1) for x in range(need, most + 1))


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k word hashes."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n]
            h ^= h >> np.uint64(29)
    return h


class ItemIndex:
    """The pieces of all items by their length: sorted hashes with the place of each."""

    def __init__(self, items: list[tuple[int, str]], part: int = PART, one_in: int = ONE_IN):
        self.vocab: dict[str, int] = {}
        self.memo: dict[str, int] = {}
        self.one_in = one_in
        self.ids, self.words, self.start, self.need, self.most = [], [], [], [], []
        self.pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        raw: dict[int, list] = {}
        flat, at = [], 0
        for item, text in items:
            w = word_list(text)
            if not w:
                continue
            number = len(self.ids)
            need, most, size = needs(len(w), part, one_in)
            if most - size > WIDEST:
                raise ValueError(f"parts of {most} words are too long to verify")
            own = np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], np.int64)
            self.ids.append(item)
            self.start.append(at)
            self.need.append(need)
            self.most.append(most)
            flat.append(own)
            at += len(own)
            h = gram_hashes(spread(own), size)
            raw.setdefault(size, []).append((h, np.full(len(h), number), np.arange(len(h))))
        self.flat = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        self.start = np.array(self.start + [at], np.int64)
        self.need, self.most = np.array(self.need, np.int64), np.array(self.most, np.int64)
        for size, parts in raw.items():
            h, number, off = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            self.pieces[size] = (h[order], number[order], off[order])

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in a row, 0 for words of no item, and the words of each text.

        A word is folded once as it stands; later it is looked up.
        """
        memo, ids, lens = self.memo, [], np.zeros(len(texts), np.int64)
        if len(memo) > 500_000:
            memo.clear()
        get = memo.get
        for i, t in enumerate(texts):
            raw = t.split() if t else []
            own = [get(x) for x in raw]
            if None in own:
                for k in [k for k, x in enumerate(own) if x is None]:
                    w = DROP.sub("", folded(raw[k]))
                    own[k] = memo[raw[k]] = self.vocab.get(w, 0) if w else -1
            if -1 in own:
                own = [x for x in own if x >= 0]
            lens[i] = len(own)
            ids += own
        return np.array(ids, np.int64), lens


def spread(ids: np.ndarray) -> np.ndarray:
    """Word numbers to well-mixed 64-bit values (splitmix)."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return z ^ (z >> np.uint64(31))


def window(flat: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray, step: int, width: int, fill: int) -> np.ndarray:
    """Rows flat[first], flat[first + step], ... where inside [low, high), else the filler."""
    at = first[:, None] + step * np.arange(width)[None, :]
    ok = (at >= low[:, None]) & (at < high[:, None])
    return np.where(ok, flat[np.clip(at, 0, len(flat) - 1)], fill)


def reach(pattern: np.ndarray, text: np.ndarray, budget: int) -> np.ndarray:
    """For each row and each e up to the budget: the longest prefix of the pattern within e edits of a prefix of the text.

    Myers' bit-parallel columns, a row of the arrays for each hit; the distance
    of every prefix is read off the vertical differences.
    """
    n, m = pattern.shape
    out = np.zeros((n, budget + 1), np.int64)
    if not n or not m:
        return out
    if m > WIDEST:
        raise ValueError(f"a pattern of {m} words, over {WIDEST}")
    bit = (np.uint64(1) << np.arange(m, dtype=np.uint64))[None, :]
    pv, mv = np.full(n, (1 << m) - 1, np.uint64), np.zeros(n, np.uint64)
    one = np.uint64(1)
    length = np.arange(1, m + 1)[None, :]
    real = pattern[:, :m] != -1
    length = np.where(real, length, 0).astype(np.int8)

    def bits(x: np.ndarray) -> np.ndarray:
        return np.unpackbits(x.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :m].view(np.int8)

    base = np.arange(1, m + 1)

    def note(j: int, pv: np.ndarray, mv: np.ndarray) -> None:
        d = np.cumsum(bits(pv) - bits(mv), 1, dtype=np.int8) + np.int8(j)
        for e in range(budget + 1):
            np.maximum(out[:, e], ((d <= e) * length).max(1), out=out[:, e])

    for e in range(budget + 1):  # only missing words
        out[:, e] = np.minimum(np.where(real, base[None, :], 0).max(1), e)
    with np.errstate(over="ignore"):
        for j in range(text.shape[1]):
            eq = np.where((pattern[:, :m] == text[:, j : j + 1]) & real, bit, np.uint64(0)).sum(1, dtype=np.uint64)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv)
            mh = pv & xh
            ph = (ph << one) | one  # the first row grows: both prefixes start at the hit
            mh = mh << one
            pv = mh | ~(xv | ph)
            mv = ph & xv
            note(j + 1, pv, mv)
    return out


def most_reach(pattern: np.ndarray, text: np.ndarray, budget: int) -> np.ndarray:
    """What ``reach`` can't exceed, cheaply: a word that the text lacks within ``budget`` places of its own costs an edit."""
    n, m = pattern.shape
    near = np.zeros((n, m), bool)
    for s in range(-budget, budget + 1):
        lo = max(0, -s)
        if lo < m:
            near[:, lo:] |= pattern[:, lo:] == text[:, lo + s : m + s]
    lost = np.cumsum(~near, 1)
    real = pattern != -1
    return np.stack([((lost <= e) & real).sum(1) for e in range(budget + 1)], 1)


def long_enough(left: np.ndarray, run: np.ndarray, right: np.ndarray, need: np.ndarray, one_in: int) -> np.ndarray:
    """Whether some division of edits gives a part of at least the need with one edit in ``one_in``."""
    most = left.shape[1] - 1
    ok = np.zeros(len(run), bool)
    for e in range(most + 1):
        for f in range(most + 1 - e):
            length = left[:, e] + run + right[:, f]
            ok |= (length >= need) & (e + f <= length // one_in)
    return ok


def verified(index: ItemIndex, doc: np.ndarray, doc_start: np.ndarray, hits: tuple[np.ndarray, np.ndarray, np.ndarray], size: int, block: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(document number, item number) of the hits whose surroundings reach a part of at least the need with one edit in ``one_in`` words.

    hits: place in ``doc``, item number, offset in the item. Hits in a row on
    one diagonal are one exact run.
    """
    at, number, off = hits
    order = np.lexsort((at, at - off, number))
    at, number, off = at[order], number[order], off[order]
    row = np.searchsorted(doc_start, at, "right") - 1
    new = np.r_[True, (number[1:] != number[:-1]) | (at[1:] != at[:-1] + 1) | (off[1:] != off[:-1] + 1) | (row[1:] != row[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(at)] - 1
    run = at[last] - at[first] + size
    number, row, a, o = number[first], row[first], at[first], off[first]
    need, longest = index.need[number], index.most[number]
    found = run >= need
    pairs_row, pairs_item = [row[found]], [number[found]]
    todo = np.flatnonzero(~found)
    most = int((longest // index.one_in).max(initial=0))
    for b in range(0, len(todo), block):
        t = todo[b : b + block]
        width = int((longest[t] - run[t]).max())
        lo, hi = index.start[number[t]], index.start[number[t] + 1]
        dlo, dhi = doc_start[row[t]], doc_start[row[t] + 1]
        left_i = window(index.flat, lo + o[t] - 1, lo, hi, -1, width, -1)
        right_i = window(index.flat, lo + o[t] + run[t], lo, hi, 1, width, -1)
        left_d = window(doc, a[t] - 1, dlo, dhi, -1, width + most, 0)
        right_d = window(doc, a[t] + run[t], dlo, dhi, 1, width + most, 0)
        may = np.flatnonzero(long_enough(most_reach(left_i, left_d, most), run[t], most_reach(right_i, right_d, most), need[t], index.one_in))
        t, left_i, right_i, left_d, right_d = t[may], left_i[may], right_i[may], left_d[may], right_d[may]
        ok = long_enough(reach(left_i, left_d, most), run[t], reach(right_i, right_d, most), need[t], index.one_in)
        pairs_row.append(row[t][ok])
        pairs_item.append(number[t][ok])
    return np.concatenate(pairs_row), np.concatenate(pairs_item)


def find(index: ItemIndex, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, item number) pairs of all leaks in these texts, distinct."""
    doc, lens = index.numbers(texts)
    start = np.r_[0, np.cumsum(lens)]
    mixed = spread(doc)
    rows, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size, (h, number, off) in index.pieces.items():
        own = gram_hashes(mixed, size)
        lo = np.searchsorted(h, own)
        seen = np.flatnonzero((lo < len(h)) & (h[np.minimum(lo, len(h) - 1)] == own))
        if not len(seen):
            continue
        row = np.searchsorted(start, seen, "right") - 1
        seen = seen[seen + size <= start[row + 1]]  # not across two texts
        lo = np.searchsorted(h, own[seen])
        hi = np.searchsorted(h, own[seen], "right")
        n = hi - lo
        # A piece of many items multiplies with its places; blocks of whole texts bound what is held at once.
        text = np.searchsorted(start, seen, "right") - 1
        block = np.cumsum(n) // HELD
        edges = np.unique(np.searchsorted(text, text[np.flatnonzero(np.r_[True, block[1:] != block[:-1]])])) if len(seen) else []
        for a, b in zip(edges, [*edges[1:], len(seen)]):
            own_n = n[a:b]
            k = np.repeat(lo[a:b] - np.r_[0, np.cumsum(own_n)[:-1]], own_n) + np.arange(own_n.sum())
            r, j = verified(index, doc, start, (np.repeat(seen[a:b], own_n), number[k], off[k]), size)
            rows.append(r)
            numbers.append(j)
    pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(numbers)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", part: int = PART, one_in: int = ONE_IN, item_rows: int = 20_000, blocks: int = 1) -> DataFrame:
    """Distinct (doc_id, item_id) of every document that holds a leak of an item.

    ``blocks`` splits the items by hash where they are more than ``item_rows``.
    """
    spark = docs.sparkSession
    doc_type, item_type = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()

    def one(b: int) -> DataFrame:
        own = items.select(item_id, text).filter(F.col(text).isNotNull())
        if blocks > 1:
            own = own.filter(F.pmod(F.xxhash64(item_id), F.lit(blocks)) == b)
        known = [(r[0], r[1]) for r in bounded_rows(own.distinct(), item_rows, "a block of test items")]
        bc = spark.sparkContext.broadcast(ItemIndex(sorted(known, key=lambda x: (x[0] is None, x[0], x[1])), part, one_in))

        def run(batches):
            index = bc.value
            for pdf in batches:
                for a in range(0, len(pdf), 1000):
                    p = pdf.iloc[a : a + 1000]
                    r, j = find(index, p["_text"].tolist())
                    if len(r):
                        yield pd.DataFrame({"d": p["_id"].to_numpy()[r], "i": [index.ids[x] for x in j]})

        return docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).filter("_text IS NOT NULL").mapInPandas(run, f"d {doc_type}, i {item_type}")

    found = reduce(DataFrame.unionByName, [one(b) for b in range(blocks)])
    return found.select(F.col("d").alias(doc_id), F.col("i").alias(item_id)).distinct()
