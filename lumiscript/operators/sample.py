"""Samples that depend on seeds and keys only, never on partitions."""

from __future__ import annotations

import bisect
import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumiscript.operators.detect import drawn

SEED = 20260825


def quotas(sizes: dict[str, int], target: int, least: int = 5) -> dict[str, int]:
    """Rows to draw from each stratum: by its share, at least ``least`` and at most all of it, adding up to the target.

    What is over is cut off the top: to the highest level at which it is gone,
    and one row more by name where that isn't enough. What is missing goes to
    the strata that are least filled, from a heap; ties by name.
    """
    names = sorted(sizes)
    n = np.array([sizes[s] for s in names], np.int64)
    if target >= n.sum():
        return dict(sizes)
    low = np.minimum(n, least)
    q = np.clip(np.array([round(target * int(x) / int(n.sum())) for x in n]), low, n)
    over = int(q.sum()) - target
    if over > 0:
        above = lambda level: int((q - np.maximum(np.minimum(q, level), low)).sum())
        level = bisect.bisect_left(range(int(q.max()) + 1), True, key=lambda v: above(v) <= over)
        over -= above(level)
        q = np.maximum(np.minimum(q, level), low)
        q[np.flatnonzero((q == level) & (q > low))[:over]] -= 1
    heap = [(q[i] / n[i], i) for i in range(len(q)) if q[i] < n[i]]
    heapq.heapify(heap)
    for _ in range(target - int(q.sum())):
        _, i = heapq.heappop(heap)
        q[i] += 1
        if q[i] < n[i]:
            heapq.heappush(heap, (q[i] / n[i], i))
    return dict(zip(names, q.tolist()))


def stratified_sample(rows: DataFrame, stratum: str, key: str, target: int, least: int = 5, seed: int = SEED, strata: int = 10_000) -> DataFrame:
    """A sample of ``target`` rows by strata. The table of strata (its size is checked) is settled on the driver; the draw is a window.

    The draw is even, so a cut a little above a stratum's share leaves about its
    quota before anything is shuffled or ordered; should a stratum be left with
    fewer rows than its quota, nothing is cut.
    """
    name = F.coalesce(F.col(stratum).cast("string"), F.lit("UNKNOWN"))

    def counts(df: DataFrame) -> dict[str, int]:
        table = df.groupBy("_s").agg(F.count("*").alias("n")).limit(strata + 1).collect()
        if len(table) > strata:
            raise ValueError(f"over {strata} strata")
        return {r["_s"]: r.n for r in table}

    named = rows.withColumn("_s", name)
    sizes = counts(named)
    q = quotas(sizes, target, least)
    cut = {s: min(1.0, (k + 6 * math.sqrt(k) + 20) / sizes[s]) for s, k in q.items()}
    want = rows.sparkSession.createDataFrame([(s, k, int(cut[s] * 2**32)) for s, k in sorted(q.items())] or [("", 0, 0)], "_s string, _q bigint, _cut bigint")
    drawn_rows = named.withColumn("_d", drawn(seed, key)).join(F.broadcast(want), "_s")
    few = drawn_rows.filter(F.conv(F.left("_d", F.lit(8)), 16, 10).cast("bigint") <= F.col("_cut"))
    left = counts(few)
    w = Window.partitionBy("_s").orderBy("_d", key)
    picked = (few if all(left.get(s, 0) >= k for s, k in q.items()) else drawn_rows).withColumn("_rn", F.row_number().over(w)).filter("_rn <= _q")
    return picked.drop("_s", "_q", "_d", "_rn", "_cut")


def coverage(sample: DataFrame, population: DataFrame, stratum: str) -> DataFrame:
    """stratum, n_population, n_sample, share_deviation; strata that the sample lacks have 0."""
    name = F.coalesce(F.col(stratum).cast("string"), F.lit("UNKNOWN"))
    p = population.groupBy(name.alias("stratum")).agg(F.count("*").alias("n_population"))
    s = sample.groupBy(name.alias("stratum")).agg(F.count("*").alias("n_sample"))
    one = Window.partitionBy(F.lit(1))  # a row for each stratum
    both = p.join(s, "stratum", "left").withColumn("n_sample", F.coalesce("n_sample", F.lit(0)))
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.sum(c).over(one)), F.lit(0.0))
    return both.withColumn("share_deviation", F.abs(share("n_population") - share("n_sample")))


def class_mix(rows: DataFrame, key: str, is_first: str, n: int = 256, share: float = 0.7, seed: int = SEED) -> DataFrame:
    """n drawn rows, ``share`` of them where ``is_first`` holds; without any others all are of the first."""
    draw = drawn(seed, key)
    w = Window.partitionBy(is_first).orderBy("_d", key)
    counts = rows.agg(F.count_if(F.col(is_first)).alias("_nf"), F.count_if(~F.col(is_first)).alias("_no"))
    first = F.when(F.col("_no") == 0, F.lit(n)).otherwise(F.least(F.col("_nf"), F.lit(int(n * share))))
    other = F.least(F.col("_no"), n - F.col("_first"))
    ranked = rows.withColumn("_d", draw).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    out = ranked.crossJoin(F.broadcast(counts)).withColumn("_first", first)  # counts is one row
    return out.filter(F.col("_rn") <= F.when(F.col(is_first), F.col("_first")).otherwise(other)).drop("_d", "_rn", "_nf", "_no", "_first")


def mix_stats(sample: DataFrame, text: str, source: str) -> DataFrame:
    """Of a small sample: n by source, upper middle and greatest length, mean share of marked letters."""
    from lumiscript.functions.text import diacritic_ratio

    rows = sample.select(F.col(source).alias("source"), F.length(text).alias("len"), diacritic_ratio(F.col(text)).alias("ratio"))
    lens = F.sort_array(F.collect_list("len"))  # bounded by the sample's size
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.get(lens, F.floor(F.count("*") / 2).cast("int")).alias("chars_median"), F.max("len").alias("chars_max"), F.round(F.avg("ratio"), 4).alias("diacritic_ratio_mean"))
