"""Problem 8: documents into containers of a fixed capacity in tokens.

Conflict-constrained best fit. The items go by size, largest first, into the
open container with the least room that still takes them; the open containers
are ordered by residual (a bucket for each residual and a bit set of the filled
buckets, so the successor of a size is one bit scan), and each carries bitmaps
of its sources and of its duplicate clusters. Where the tightest container has
a conflict, the search goes on to the next until a compatible one is found.

Conflicts: copies of one text (same text apart from case and white space) don't
share a container, and neither do sources named in ``apart``. Where a cluster
has more copies than containers are needed, its copies spread evenly: each
container may hold ceil(copies / containers needed).

Only a document over the capacity is split, into full containers and one rest
that is packed as an item. Rows are dealt into blocks of about ``block_items``
that are packed on their own, whatever their ids, so no task grows with the
data; the unused space of a block is that of its few last containers.

Defined results: rows with a null or empty text, or without tokens, take no
container; repeated rows are items of their own; capacities below 1 or null
are left out; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiscript.llm.common import bounded_rows, checkpointed

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The splitting pattern of the public byte-level vocabularies (a fixed value of theirs).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    try:
        from public_tokenizers import PATTERN as pattern
    except ImportError:
        pattern = PATTERN
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, cluster (equal for copies), n_tokens, deal (spreads the rows): a map, each text is read once."""
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches):
        enc = encoding(tokenizer)
        from pyspark import TaskContext

        seed, n = TaskContext.get().partitionId(), 0
        for pdf in batches:
            sizes = np.fromiter((len(enc.encode_ordinary(t)) for t in pdf.pop("_text")), np.int64, len(pdf))
            k = np.arange(n, n + len(pdf), dtype=np.uint64)
            n += len(pdf)
            with np.errstate(over="ignore"):
                z = (k + np.uint64(seed) * np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x9E3779B97F4A7C15)
                z ^= z >> np.uint64(32)
            yield pdf.assign(n_tokens=sizes, deal=(z & np.uint64(0x7FFFFFFF)).astype(np.int64))

    cluster = F.xxhash64(F.lower(F.trim(F.regexp_replace("_text", r"\s+", " "))))
    rows = df.select(F.col(doc_id).alias("_id"), F.col(source).cast("string").alias("_source"), F.col(text).alias("_text")).filter("_text IS NOT NULL AND _text <> ''")
    rows = rows.withColumn("_cluster", cluster).select("_id", "_source", "_cluster", "_text")
    return rows.mapInPandas(run, f"_id {kind}, _source string, _cluster bigint, n_tokens bigint, deal bigint").filter("n_tokens > 0")


def best_fit(size: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int, foes: dict[int, int] | None = None) -> np.ndarray:
    """The container of each item; sizes are between 1 and the capacity.

    ``foes`` has, by source number, the bitmap of the sources that it mustn't
    meet. Containers are numbered from 0 in the order in which they open.
    """
    n = len(size)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    foes = foes or {}
    needed = max(1, -(-int(size.sum()) // capacity))
    names, inv, copies = np.unique(cluster, return_inverse=True, return_counts=True)
    # A bit for each cluster with copies that keep apart; those with more copies than containers are counted.
    allowed = -(-copies // needed)
    bit_of = np.full(len(names), -1)
    many = np.flatnonzero((copies > 1) & (allowed == 1))
    bit_of[many] = np.arange(len(many))
    hot = (copies > 1) & (allowed > 1)
    buckets: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = 0  # bit r: some container has r tokens of room
    sources: list[int] = []
    clusters: list[int] = []
    counts: list[dict | None] = []
    order = np.lexsort((np.arange(n), -size))
    # Copies in a row would each scan the containers of the last; dealt by position, they don't.
    for i, s, c, src in zip(order.tolist(), size[order].tolist(), inv[order].tolist(), source[order].tolist()):
        own = 1 << int(bit_of[c]) if bit_of[c] >= 0 else 0
        is_hot = bool(hot[c])
        bad, me = foes.get(src, 0), 1 << src
        rest = filled >> s
        room = s
        found = -1
        while rest:
            step = (rest & -rest).bit_length() - 1
            room += step
            bucket = buckets[room]
            if not (own or is_hot or bad):
                found = len(bucket) - 1
                break
            for k in range(len(bucket) - 1, -1, -1):
                b = bucket[k]
                if clusters[b] & own or sources[b] & bad:
                    continue
                if is_hot and counts[b] is not None and counts[b].get(c, 0) >= allowed[c]:
                    continue
                found = k
                break
            if found >= 0:
                break
            rest >>= step + 1
            room += 1
        if found >= 0:
            bucket = buckets[room]
            b = bucket[found]
            bucket[found] = bucket[-1]
            bucket.pop()
            if not bucket:
                filled &= ~(1 << room)
            left = room - s
        else:
            b = len(sources)
            sources.append(0)
            clusters.append(0)
            counts.append(None)
            left = capacity - s
        out[i] = b
        sources[b] |= me
        clusters[b] |= own
        if is_hot:
            if counts[b] is None:
                counts[b] = {}
            counts[b][c] = counts[b].get(c, 0) + 1
        if left:
            if not buckets[left]:
                filled |= 1 << left
            buckets[left].append(b)
    return out


def packed(docs: DataFrame, packs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER, apart: tuple[tuple[str, str], ...] = (), block_items: int = 40_000, pack_rows: int = 1000) -> DataFrame:
    """pack_id, pack_name, doc_id, piece, first_token, n_tokens, container_id for each document or piece in each pack."""
    known = [r for r in bounded_rows(packs.select("pack_id", "pack_name", "capacity_tokens").distinct().orderBy("pack_id", "capacity_tokens", "pack_name"), pack_rows, "the table of packs") if r[2] is not None and r[2] > 0]
    sized = checkpointed(token_counts(docs, doc_id, text, source, tokenizer))
    blocks = max(1, -(-sized.count() // block_items))
    kind = docs.schema[doc_id].dataType.simpleString()
    pack_type = packs.schema["pack_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_id", "deal"], kind="stable")
        ids, size, cluster = pdf["_id"].to_numpy(), pdf["n_tokens"].to_numpy(np.int64), pdf["_cluster"].to_numpy(np.int64)
        names = sorted({*pdf["_source"].dropna(), *(x for p in apart for x in p)})
        number = {x: i + 1 for i, x in enumerate(names)}
        src = np.array([number.get(x, 0) for x in pdf["_source"]], np.int64)
        foes: dict[int, int] = {}
        for a, b in apart:
            foes[number[a]] = foes.get(number[a], 0) | 1 << number[b]
            foes[number[b]] = foes.get(number[b], 0) | 1 << number[a]
        block = int(pdf["_block"].iloc[0])
        parts = []
        for pack, name, capacity in known:
            whole = size // capacity  # full containers of a document over the capacity
            whole = np.where(size % capacity == 0, whole - (size <= capacity), whole)
            whole = np.where(size <= capacity, 0, whole)
            at = np.repeat(np.arange(len(size)), whole)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(whole) - whole, whole)
            rest = size - whole * capacity
            item = np.flatnonzero(rest > 0)
            box = best_fit(rest[item], src[item], cluster[item], int(capacity), foes)
            opened = int(box.max(initial=-1)) + 1
            every, number_ = np.concatenate([at, item]), np.concatenate([opened + np.arange(len(at)), box])
            pieces = np.concatenate([piece, whole[item]])
            parts.append(pd.DataFrame({"pack_id": pack, "pack_name": name, "d": ids[every], "piece": pieces, "first_token": pieces * capacity, "n_tokens": np.concatenate([np.full(len(at), capacity), rest[item]]), "container_id": (np.int64(block) << 32) + number_}))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["pack_id", "pack_name", "d", "piece", "first_token", "n_tokens", "container_id"])

    out = sized.withColumn("_block", F.pmod("deal", F.lit(blocks))).groupBy("_block").applyInPandas(run, f"pack_id {pack_type}, pack_name string, d {kind}, piece bigint, first_token bigint, n_tokens bigint, container_id bigint")
    return out.withColumnRenamed("d", doc_id)
