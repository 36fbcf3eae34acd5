"""Agreement of two annotators, calibration of a detector, and distributions of labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumiscript.operators.stats import SEED, resampled


def contingency(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    return pairs.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def agreement(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """by, n_items, n_categories, percent_agreement, ac1, kappa over the categories that occur."""
    cells = contingency(pairs, by, a, b)
    total = cells.groupBy(*by).agg(F.sum("n").alias("n_items"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    side = lambda c: cells.select(*by, F.col(c).alias("cat"), F.when(F.lit(c == "a"), F.col("n")).otherwise(0).alias("na"), F.when(F.lit(c == "b"), F.col("n")).otherwise(0).alias("nb"))
    cats = side("a").unionByName(side("b")).groupBy(*by, "cat").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    joined = cats.join(total, by) if by else cats.crossJoin(F.broadcast(total))
    pa, pb = F.col("na") / F.col("n_items"), F.col("nb") / F.col("n_items")
    pi = (pa + pb) / 2
    g = joined.groupBy(*by, "n_items", "same").agg(F.count("*").alias("n_categories"), F.sum(pi * (1 - pi)).alias("spread"), F.sum(pa * pb).alias("pe"))
    po = F.col("same") / F.col("n_items")
    pg = F.try_divide(F.col("spread"), (F.col("n_categories") - 1).cast("double"))
    beyond = lambda e: F.when((F.col("n_categories") < 2) | (e >= 1), 1.0).otherwise((po - e) / (1 - e))
    return g.select(*by, F.col("n_items").cast("bigint").alias("n_items"), "n_categories", po.alias("percent_agreement"), beyond(pg).alias("ac1"), beyond(F.col("pe")).alias("kappa"))


def ac1_of(x: np.ndarray) -> np.ndarray:
    """AC1 of rows of cell counts (both, only a, only b, neither)."""
    n = x.sum(1)
    pi = (2 * x[:, 0] + x[:, 1] + x[:, 2]) / (2 * n)
    pe = 2 * pi * (1 - pi)
    return np.where((pi == 0) | (pi == 1), 1.0, ((x[:, 0] + x[:, 3]) / n - pe) / np.maximum(1 - pe, 1e-12))


def kappa_of(x: np.ndarray) -> np.ndarray:
    n = x.sum(1)
    a, b = (x[:, 0] + x[:, 1]) / n, (x[:, 0] + x[:, 2]) / n
    pe = a * b + (1 - a) * (1 - b)
    return np.where(pe >= 1, 1.0, ((x[:, 0] + x[:, 3]) / n - pe) / np.maximum(1 - pe, 1e-12))


def agreement_bounds(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b", times: int = 2000, seed: int = SEED) -> DataFrame:
    """Bootstrap bounds of AC1 and kappa of two boolean columns, from the four cells."""
    x, y = F.col(a).cast("int"), F.col(b).cast("int")
    cells = pairs.groupBy(*by).agg(*[F.count_if((x == i) & (y == j)).alias(f"c{i}{j}") for i in (1, 0) for j in (1, 0)])

    @F.pandas_udf("struct<ac1_low:double,ac1_high:double,kappa_low:double,kappa_high:double>")
    def bounds(c11: pd.Series, c10: pd.Series, c01: pd.Series, c00: pd.Series) -> pd.DataFrame:
        rows = [(*resampled(np.array(c), ac1_of, times, seed), *resampled(np.array(c), kappa_of, times, seed)) for c in zip(c11, c10, c01, c00)]
        return pd.DataFrame(rows, columns=["ac1_low", "ac1_high", "kappa_low", "kappa_high"])

    return cells.withColumn("_b", bounds("c11", "c10", "c01", "c00")).select(*by, "_b.*")


def interpret(ac1: Column) -> Column:
    return F.when(ac1 < 0, "worse than chance").when(ac1 < 0.2, "very low").when(ac1 < 0.4, "low").when(ac1 < 0.6, "moderate").when(ac1 < 0.8, "substantial").otherwise("high")


def paired_labels(labels: DataFrame, first: Column, second: Column, codes: list[str], keys: list[str] = ["tag", "id"]) -> DataFrame:
    """keys, code, a, b: the labels of two annotators on the items that both judged; a missing code is false."""
    side = lambda cond, name: labels.filter(cond).groupBy(*keys).agg(F.max_by("labels", F.struct(F.col("labelled_at"), F.to_json("labels"))).alias(name))
    both = side(first, "_a").join(side(second, "_b"), keys)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.coalesce(F.col("_a")[c], F.lit(False)).alias("a"), F.coalesce(F.col("_b")[c], F.lit(False)).alias("b")) for c in codes]))
    return both.select(*keys, each.alias("_c")).select(*keys, "_c.*")


def prevalence(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("code").agg(F.avg((F.col("a") | F.col("b")).cast("double")).alias("prevalence"))


def calibration(truth: DataFrame, machine: DataFrame, keys: list[str]) -> DataFrame:
    """code, tp, fp, fn, precision, recall of ``machine`` (keys, code, flag) against ``truth`` (keys, code, label); a missing flag is false."""
    both = truth.join(machine, [*keys, "code"], "left").withColumn("f", F.coalesce("flag", F.lit(False)))
    g = both.groupBy("code").agg(F.count_if(F.col("label") & F.col("f")).alias("tp"), F.count_if(~F.col("label") & F.col("f")).alias("fp"), F.count_if(F.col("label") & ~F.col("f")).alias("fn"))
    share = lambda a, b: F.try_divide(F.col("tp").cast("double"), F.col(a) + F.col(b))
    return g.withColumn("precision", share("tp", "fp")).withColumn("recall", share("tp", "fn"))


def merged_labels(labels: DataFrame, codes: list[str], keys: list[str] = ["tag", "id"]) -> DataFrame:
    """keys, one boolean for each code: true where any annotator says so."""
    return labels.groupBy(*keys).agg(*[F.coalesce(F.bool_or(F.col("labels")[c]), F.lit(False)).alias(c) for c in codes])


def error_distribution(merged: DataFrame, codes: list[str], tag: str = "tag", least: int = 15) -> DataFrame:
    """tag, n, percent of each code as text; small cells are suppressed."""
    g = merged.groupBy(tag).agg(F.count("*").alias("n"), *[F.bround(100 * F.avg(F.col(c).cast("double")), 1).alias(c) for c in codes])
    return g.select(tag, "n", *[F.when(F.col("n") < least, f"n<{least}").otherwise(F.format_string("%.1f", c)).alias(c) for c in codes])


def ordered_tags(rows: DataFrame, order: list[str], tag: str = "tag") -> DataFrame:
    """By model, then by the place of the precision in ``order``, unknown ones last."""
    from lumiscript.functions.text import model_of, precision_of

    place = F.array_position(F.array(*[F.lit(x) for x in order]), precision_of(F.col(tag)))
    return rows.orderBy(model_of(F.col(tag)), F.when(place == 0, 99).otherwise(place), tag)
