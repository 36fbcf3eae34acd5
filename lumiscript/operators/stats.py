"""Paired tests, corrections for many tests, floors, flips and latency.

The p-values are native: the error function is a series of positive terms,
folded over a fixed sequence. What needs resampling or binomial tails works on
counts of outcome cells in a pandas UDF, never on the items.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 20260825
TERMS = 240


def erf(x: Column) -> Column:
    """By 2/sqrt(pi) exp(-x^2) sum 2^n x^(2n+1) / (2n+1)!!; 1 beyond 6."""
    a = F.least(F.abs(x), F.lit(6.0))
    zero = F.struct(a.alias("term"), a.alias("sum"))

    def step(s: Column, n: Column) -> Column:
        term = s["term"] * 2 * a * a / (2 * n + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), zero, step, lambda s: s["sum"])
    value = F.least(2 / math.sqrt(math.pi) * F.exp(-a * a) * series, F.lit(1.0))
    return F.when(x < 0, -value).when(x >= 0, value)


def erfc(x: Column) -> Column:
    return 1 - erf(x)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal."""
    return 0.5 * erfc(z / math.sqrt(2))


def binomial_two_sided(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c at even odds; meant for b + c under 25."""
    n, k = (b + c).cast("double"), F.least(b, c)
    first = F.pow(F.lit(2.0), -n)
    zero = F.struct(first.alias("term"), first.alias("sum"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * (n - i + 1) / i
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(steps, zero, step, lambda s: s["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def mcnemar(pairs: DataFrame, by: list[str], ref: str = "ref", cmp: str = "cmp") -> DataFrame:
    """by, n, acc_ref, acc, delta, flip_down, flip_up, statistic, p_value, exact: the paired test of two boolean columns."""
    r, c = F.col(ref).cast("int"), F.col(cmp).cast("int")
    g = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg(r).alias("acc_ref"), F.avg(c).alias("acc"), F.count_if((r == 1) & (c == 0)).alias("flip_down"), F.count_if((r == 0) & (c == 1)).alias("flip_up"))
    b, u = F.col("flip_down"), F.col("flip_up")
    exact = (b + u) < 25
    yates = F.try_divide(F.pow(F.abs(b - u) - 1.0, F.lit(2.0)), (b + u).cast("double"))
    few = F.when(exact, b).otherwise(F.lit(0)), F.when(exact, u).otherwise(F.lit(0))
    p = F.when(exact, binomial_two_sided(*few)).otherwise(erfc(F.sqrt(F.coalesce(yates, F.lit(0.0)) / 2)))
    return g.withColumn("delta", F.col("acc") - F.col("acc_ref")).withColumn("statistic", F.when(exact, F.least(b, u).cast("double")).otherwise(yates)).withColumn("p_value", p).withColumn("exact", exact)


def holm(tests: DataFrame, label: str, p: str = "p_value", by: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Adds p_holm and significant_holm: the running maximum of p times the tests that are left."""
    one = Window.partitionBy(*(by or [F.lit(1)]))
    w = one.orderBy(p, label)
    left = F.count("*").over(one) - F.row_number().over(w) + 1
    adj = F.least(F.lit(1.0), F.max("_a").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return tests.withColumn("_a", F.col(p) * left).withColumn("p_holm", adj).drop("_a").withColumn("significant_holm", F.col("p_holm") < alpha)


def benjamini_hochberg(tests: DataFrame, label: str, p: str = "p_value", by: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Adds p_bh and significant_bh: from the largest, the running minimum of p times tests over rank."""
    one = Window.partitionBy(*(by or [F.lit(1)]))
    w = one.orderBy(p, label)
    adj = F.least(F.lit(1.0), F.min("_a").over(w.rowsBetween(0, Window.unboundedFollowing)))
    return tests.withColumn("_a", F.col(p) * F.count("*").over(one) / F.row_number().over(w)).withColumn("p_bh", adj).drop("_a").withColumn("significant_bh", F.col("p_bh") < alpha)


def floor_check(rows: DataFrame, acc: str = "acc", n: str = "n", baseline: float = 0.2532, alpha: float = 0.05) -> DataFrame:
    """Adds z, p_floor, at_floor, floor_note, floor_accuracy, drop_budget_pts."""
    count = F.nullif(F.col(n), F.lit(0))
    se = F.sqrt(F.lit(baseline * (1 - baseline)) / count)
    z = (F.col(acc) - baseline) / se
    p = upper_tail(z)
    floor = F.coalesce(p >= alpha, F.lit(True))
    note = F.when(count.isNull(), "no rows").when(floor, "at the floor").when(F.col(acc) - baseline < 0.05, "near the floor").otherwise("above the floor")
    limit = F.coalesce(F.lit(baseline) + 1.6448536269514722 * se, F.lit(1.0))
    return rows.withColumns({"z": z, "p_floor": p, "at_floor": floor, "floor_note": note, "floor_accuracy": limit, "drop_budget_pts": F.round((F.col(acc) - limit) * 100, 1)})


def margin_of_error(n: Column, p: float = 0.5, z: float = 1.959963985) -> Column:
    """Also the least difference that n items can show."""
    return F.when(n > 0, F.lit(z) * F.sqrt(F.lit(p * (1 - p)) / n))


def sampling_error(n: Column, population: Column, p: float = 0.5, z: float = 1.96) -> Column:
    """Margin of error of a share with the finite population's correction."""
    correction = F.when(population > 1, F.sqrt((population - n) / (population - 1))).otherwise(1.0)
    return F.when(n > 0, F.lit(z) * F.sqrt(F.lit(p * (1 - p)) / n) * correction)


def latest_per(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def degradation(scores: DataFrame, model: str = "model", precision: str = "precision", value: str = "value", reference: str = "bf16") -> DataFrame:
    """Adds ref, delta_abs, delta_rel_pct against the reference precision of the model; one row per model and precision."""
    w = Window.partitionBy(model)
    ref = F.max(F.when(F.col(precision) == reference, F.col(value))).over(w)
    out = scores.withColumn("ref", ref)
    return out.withColumn("delta_abs", F.col(value) - F.col("ref")).withColumn("delta_rel_pct", 100 * F.try_divide(F.col(value) - F.col("ref"), F.col("ref")))


def flip_rate(pairs: DataFrame, by: list[str], ref: str = "ref_pred", cmp: str = "cmp_pred") -> DataFrame:
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(ref) != F.col(cmp)).alias("n_flip")).withColumn("flip_rate", F.col("n_flip") / F.col("n"))


def flip_directions(pairs: DataFrame, by: list[str], ref: str = "ref_pred", cmp: str = "cmp_pred", k: int = 10) -> DataFrame:
    """The k most frequent changes, as ``a->b``."""
    c = pairs.filter(F.col(ref) != F.col(cmp)).groupBy(*by, F.concat(ref, F.lit("->"), cmp).alias("direction")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "direction")
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def flip_by_group(pairs: DataFrame, group: str, ref: str = "ref_pred", cmp: str = "cmp_pred", least: int = 30) -> DataFrame:
    out = flip_rate(pairs, [group], ref, cmp).filter(F.col("n") >= least).withColumn("flip_rate", F.bround("flip_rate", 4))
    return out.orderBy(F.desc("flip_rate"), group)


def expected_harmful_share(acc: Column, k: Column) -> Column:
    """Share of right-to-wrong among the changes of right or wrong, if changes are random among k choices."""
    back = (1 - acc) / F.nullif(k - 1, F.lit(0.0))
    return F.when(k <= 1, 1.0).otherwise(F.coalesce(F.try_divide(acc, acc + back), F.lit(1.0)))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k), summed in logarithms."""
    if n <= 0 or k <= 0:
        return 1.0
    if p <= 0:
        return 0.0
    if p >= 1:
        return 1.0
    i = np.arange(min(k, n), n + 1)
    lg = np.vectorize(math.lgamma)
    logs = math.lgamma(n + 1) - lg(i + 1.0) - lg(n - i + 1.0) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def validate_proxy(triples: DataFrame, by: list[str], ref: str = "ref_pred", cmp: str = "cmp_pred", gold: str = "gold", k: float = 4.0) -> DataFrame:
    """Whether changes break right answers more often than random changes of the same number would."""
    a, b = (F.col(ref) == F.col(gold)).cast("int"), (F.col(cmp) == F.col(gold)).cast("int")
    g = triples.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(ref) != F.col(cmp)).cast("int")).alias("flip_rate"), F.avg(a).alias("acc_ref"), F.avg(b).alias("acc_cmp"), F.count_if((a == 1) & (b == 0)).alias("flip_down"), F.count_if((a == 0) & (b == 1)).alias("flip_up"))
    g = g.withColumn("harmful_share", F.coalesce(F.try_divide(F.col("flip_down").cast("double"), F.col("flip_down") + F.col("flip_up")), F.lit(0.0))).withColumn("harmful_expected", expected_harmful_share(F.col("acc_ref"), F.lit(float(k))))

    @F.pandas_udf("double")
    def tail(down: pd.Series, up: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([binomial_tail(int(d), int(d + u), float(x)) if d + u else 1.0 for d, u, x in zip(down, up, p)])

    g = g.withColumn("p_value", tail("flip_down", "flip_up", "harmful_expected"))
    verdict = F.when(F.col("flip_down") + F.col("flip_up") < 20, "too few changes").when(F.col("p_value") < 0.05, "more harmful than random").otherwise("no more harmful than random")
    return g.withColumn("excess", F.col("harmful_share") - F.col("harmful_expected")).withColumn("verdict", verdict)


def order_statistics(values: np.ndarray, alpha: float = 0.05) -> tuple[float, float]:
    v = np.sort(values)
    return float(v[int(alpha / 2 * len(v))]), float(v[min(len(v) - 1, int((1 - alpha / 2) * len(v)))])


def resampled(cells: np.ndarray, statistic, times: int, seed: int = SEED) -> tuple[float, float]:
    """Bounds of a statistic of cell counts over multinomial resamples: as resampling the items, without them."""
    n = int(cells.sum())
    if n == 0:
        return float("nan"), float("nan")
    draws = np.random.default_rng(seed).multinomial(n, cells / n, size=times)
    return order_statistics(statistic(draws))


def paired_bootstrap(pairs: DataFrame, by: list[str], ref: str = "ref", cmp: str = "cmp", times: int = 5000, seed: int = SEED) -> DataFrame:
    """by, ci_low, ci_high of the difference of accuracies, from the two cells in which they differ."""
    r, c = F.col(ref).cast("int"), F.col(cmp).cast("int")
    g = pairs.groupBy(*by).agg(F.count_if((r == 1) & (c == 0)).alias("down"), F.count_if((r == 0) & (c == 1)).alias("up"), F.count_if(r == c).alias("same"))

    @F.pandas_udf("struct<ci_low:double,ci_high:double>")
    def bounds(down: pd.Series, up: pd.Series, same: pd.Series) -> pd.DataFrame:
        rows = [resampled(np.array([d, u, s]), lambda x: (x[:, 1] - x[:, 0]) / x.sum(1), times, seed) for d, u, s in zip(down, up, same)]
        return pd.DataFrame(rows, columns=["ci_low", "ci_high"])

    return g.withColumn("_c", bounds("down", "up", "same")).select(*by, "_c.ci_low", "_c.ci_high")


def cell_bootstrap(rows: DataFrame, by: list[str], cells: dict[str, Column], statistic, times: int = 2000, seed: int = SEED) -> DataFrame:
    """by, ci_low, ci_high of a statistic of the user's: a vectorised function of resampled counts of the cells (times x cells)."""
    names = list(cells)
    g = rows.groupBy(*by).agg(*[F.count_if(c).alias(k) for k, c in cells.items()])

    @F.pandas_udf("struct<ci_low:double,ci_high:double>")
    def bounds(c: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([resampled(np.array(r), statistic, times, seed) for r in c[names].itertuples(index=False)], columns=["ci_low", "ci_high"])

    return g.withColumn("_c", bounds(F.struct(*names))).select(*by, "_c.ci_low", "_c.ci_high")


def flip_bootstrap(pairs: DataFrame, by: list[str], ref: str = "ref_pred", cmp: str = "cmp_pred", times: int = 2000, seed: int = SEED) -> DataFrame:
    g = flip_rate(pairs, by, ref, cmp)

    @F.pandas_udf("struct<ci_low:double,ci_high:double>")
    def bounds(n: pd.Series, k: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([resampled(np.array([b, a - b]), lambda x: x[:, 0] / x.sum(1), times, seed) for a, b in zip(n, k)], columns=["ci_low", "ci_high"])

    return g.withColumn("_c", bounds("n", "n_flip")).select(*by, "n", "n_flip", "flip_rate", "_c.ci_low", "_c.ci_high")


def matched_pairs(ref: DataFrame, cmp: DataFrame, keys: list[str]) -> DataFrame:
    """keys and both sides' columns, one row for each item; raises unless both sides have exactly the same items once each."""
    both = ref.withColumn("_r", F.lit(1)).join(cmp.withColumn("_c", F.lit(1)), keys, "full")
    odd = both.groupBy(*keys).agg(F.count("*").alias("n"), F.count("_r").alias("r"), F.count("_c").alias("c")).filter("n <> 1 OR r <> 1 OR c <> 1").limit(1).count()
    if odd:
        raise ValueError("the two sides don't have the same items")
    return both.drop("_r", "_c")


def paired_significance(items: DataFrame, item: str = "item_id", model: str = "model", precision: str = "precision", ok: str = "ok", reference: str = "bf16", times: int = 5000) -> DataFrame:
    """The paired test of each precision against the reference over the same items, with bounds and corrections over all tests.

    A precision whose items aren't exactly the reference's gets a note and no test.
    """
    ref = items.filter(F.col(precision) == reference).select(F.col(model).alias("model"), F.col(item).alias("item"), F.col(ok).alias("ref"))
    other = items.filter(F.col(precision) != reference).select(F.col(model).alias("model"), F.col(precision).alias("precision"), F.col(item).alias("item"), F.col(ok).alias("cmp"))
    size = ref.groupBy("model").agg(F.count("*").alias("n_ref"))
    both = other.join(ref, ["model", "item"], "left")
    fits = both.groupBy("model", "precision").agg(F.count("*").alias("n_cmp"), F.count("ref").alias("n_both")).join(size, "model", "left")
    fits = fits.withColumn("note", F.when((F.col("n_cmp") != F.coalesce("n_ref", F.lit(0))) | (F.col("n_both") != F.col("n_cmp")), "items differ from the reference's")).select("model", "precision", "note")
    tested = both.join(fits.filter("note IS NULL"), ["model", "precision"], "left_semi")
    by = ["model", "precision"]
    out = mcnemar(tested, by).join(paired_bootstrap(tested, by, times=times), by).withColumn("label", F.concat_ws("@", *by))
    out = holm(out, "label").drop("label")
    return fits.join(out, by, "left")


def exact_ranks(rows: DataFrame, by: list[str], ranks: dict[str, tuple[float, Column]], eps: float = 0.01) -> DataFrame:
    """by, measure, name, value: the values at given ranks of each group, whatever the size of a group.

    ``rows`` has measure and value beside ``by``; ``ranks`` gives by name the
    share of the rows below the rank, about, and the rank (from 0) in terms of n.
    A sketch, ten times as fine as ``eps``, gives bounds on both sides of each
    share; the rows below are counted, and only the different values between the
    bounds, counted, are put in order.
    """
    keys = [*by, "measure"]
    shares = sorted({q for q, _ in ranks.values()})
    ends = [min(1.0, max(0.0, x)) for q in shares for x in (q - eps, q + eps)]
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("value", ends, int(10 / eps)).alias("_e"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    low = lambda i: F.when(F.lit(shares[i] - eps > 0), F.get("_e", F.lit(2 * i))).otherwise(F.col("_lo"))
    high = lambda i: F.when(F.lit(shares[i] + eps < 1), F.get("_e", F.lit(2 * i + 1))).otherwise(F.col("_hi"))
    bounds = sketch.select(*keys, "n", *[low(i).alias(f"_l{i}") for i in range(len(shares))], *[high(i).alias(f"_h{i}") for i in range(len(shares))])
    placed = rows.join(F.broadcast(bounds), keys)  # a row for each group
    before = placed.groupBy(*keys, "n").agg(*[F.count_if(F.col("value") < F.col(f"_l{i}")).alias(f"_b{i}") for i in range(len(shares))])
    inside = [F.when(F.col("value").between(F.col(f"_l{i}"), F.col(f"_h{i}")), i) for i in range(len(shares))]
    own = placed.select(*keys, "value", F.explode(F.array_compact(F.array(*inside))).alias("_i")).groupBy(*keys, "_i", "value").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_i").orderBy("value"))
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(shares.index(q)).alias("_i"), (r.cast("bigint") - F.col(f"_b{shares.index(q)}")).alias("rank")) for k, (q, r) in ranks.items()]))
    wanted = F.broadcast(before.select(*keys, asked.alias("_r")).select(*keys, "_r.*"))
    found = own.withColumn("_upto", upto).join(wanted, [*keys, "_i"])
    return found.filter((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_c"))).select(*keys, "name", "value")


def latency_summary(runs: DataFrame, by: str, ttft: str = "ttft_ms", total: str = "total_ms", tokens: str = "n_output_tokens") -> DataFrame:
    """Medians, and the value at index floor(0.95 n) of the sorted times; no group is put in order in one task."""
    gen = F.greatest(F.col(total) - F.col(ttft), F.lit(1e-6))
    several = F.col(tokens) > 1
    measures = {"ttft": F.col(ttft).cast("double"), "tps": F.when(several, (F.col(tokens) - 1) / (gen / 1000)).otherwise(0.0), "tpot": F.when(several, (F.col(total) - F.col(ttft)) / (F.col(tokens) - 1)).otherwise(0.0)}
    rows = runs.select(by, F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in measures.items()])).alias("_m")).select(by, "_m.measure", "_m.value").filter("value IS NOT NULL")
    n = F.col("n")
    found = exact_ranks(rows, [by], {"low": (0.5, F.floor((n - 1) / 2)), "high": (0.5, F.floor(n / 2)), "p95": (0.95, F.least(n - 1, F.floor(0.95 * n)))})
    at = lambda m, k: F.max(F.when((F.col("measure") == m) & (F.col("name") == k), F.col("value")))
    median = lambda m: F.round((at(m, "low") + at(m, "high")) / 2, 2)
    out = found.groupBy(by).agg(median("ttft").alias("ttft_ms_median"), F.round(at("ttft", "p95"), 2).alias("ttft_ms_p95"), median("tpot").alias("tpot_ms_median"), median("tps").alias("tokens_per_s_median"))
    return runs.groupBy(by).agg(F.count("*").alias("n_runs")).join(out, by, "left")


def mixed_machines(runs: DataFrame, model: str = "model", precision: str = "precision", machine: str = "machine") -> DataFrame:
    """Models whose precisions ran on several machines."""
    m = runs.select(model, precision, F.coalesce(machine, F.lit("unknown")).alias("m")).distinct()
    return m.groupBy(model).agg(F.countDistinct("m").alias("n_machines"), F.array_join(F.array_sort(F.collect_set("m")), ",").alias("machines")).filter("n_machines > 1")
