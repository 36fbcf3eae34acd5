"""Published values, exact sums and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiscript.operators import agreement as A
from lumiscript.operators import sample as S
from lumiscript.operators import stats

# Published flip counts and p-values of eight paired tests over 1,047 items, and their Holm correction.
PUBLISHED = [("g-fp8", 53, 52, 1.0, 1.0), ("g-gguf", 108, 70, 0.00555, 0.03885), ("g-int4", 204, 116, 0.000001, 0.000008), ("g-int8", 81, 58, 0.062039, 0.248156), ("q-fp8", 19, 38, 0.017118, 0.102708), ("q-gguf", 132, 107, 0.120559, 0.361677), ("q-int4", 120, 85, 0.017565, 0.102708), ("q-int8", 48, 42, 0.598161, 1.0)]


def cells(label, down, up, n=1047, both=300):
    return [(label, True, False)] * down + [(label, False, True)] * up + [(label, True, True)] * both + [(label, False, False)] * (n - down - up - both)


def test_published_tests(spark):
    rows = [r for label, b, c, _, _ in PUBLISHED for r in cells(label, b, c)]
    df = spark.createDataFrame(rows, "label string, ref boolean, cmp boolean")
    got = {r.label: r for r in stats.mcnemar(df, ["label"]).collect()}
    for label, b, c, p, _ in PUBLISHED:
        assert (got[label].flip_down, got[label].flip_up) == (b, c)
        assert round(got[label].p_value, 6) == pytest.approx(p, abs=1e-6)
    tests = spark.createDataFrame([(x[0], x[3]) for x in PUBLISHED], "label string, p_value double")
    holm = {r.label: r.p_holm for r in stats.holm(tests, "label").collect()}
    for label, *_, adj in PUBLISHED:
        assert holm[label] == pytest.approx(adj, abs=1e-6)


def test_exact_test(spark):
    df = spark.createDataFrame(cells("x", 3, 9, 40, 10) + cells("none", 0, 0, 20, 20), "label string, ref boolean, cmp boolean")
    got = {r.label: r for r in stats.mcnemar(df, ["label"]).collect()}
    want = 2 * sum(math.comb(12, i) for i in range(4)) / 2**12
    assert got["x"].exact and got["x"].p_value == pytest.approx(want) and got["none"].p_value == 1.0


def test_erf(spark):
    xs = [0.0, 0.1, 0.5, 1.0, 2.0, 3.3, 5.9, -1.2]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(stats.erf(F.col("x"))).collect()]
    assert got == pytest.approx([math.erf(x) for x in xs], abs=1e-12)


def test_corrections(spark):
    p = [0.001, 0.012, 0.02, 0.035, 0.04, 0.9]
    df = spark.createDataFrame([(f"t{i}", x) for i, x in enumerate(p)], "label string, p_value double")
    holm, bh = stats.holm(df, "label").orderBy("p_value").collect(), stats.benjamini_hochberg(df, "label").orderBy("p_value").collect()
    assert all(h.p_holm >= b.p_bh for h, b in zip(holm, bh))
    assert [h.p_holm for h in holm] == sorted(h.p_holm for h in holm)
    assert [b.p_bh for b in bh] == pytest.approx([0.006, 0.036, 0.04, 0.048, 0.048, 0.9])


def test_floor(spark):
    df = spark.createDataFrame([("a", 0.4011, 1047), ("b", 0.3171, 1047), ("c", 0.4947, 1047), ("d", 0.25, 1047), ("e", 0.5, 0)], "m string, acc double, n int")
    got = {r.m: r for r in stats.floor_check(df).collect()}
    assert got["a"].z == pytest.approx(11.005, abs=0.01) and got["b"].z == pytest.approx(4.755, abs=0.01) and got["c"].z == pytest.approx(17.97, abs=0.01)
    assert not got["a"].at_floor and got["d"].at_floor and got["e"].at_floor and got["e"].floor_note == "no rows"
    assert got["a"].floor_accuracy == pytest.approx(0.2753, abs=0.001)


def test_harmful_share(spark):
    df = spark.createDataFrame([(0.5,), (0.65,), (0.8,), (0.3,)], "a double")
    got = [round(r[0], 3) for r in df.select(stats.expected_harmful_share(F.col("a"), F.lit(4.0))).collect()]
    assert got == [0.75, 0.848, 0.923, 0.562]


def test_binomial_tail():
    for k, n, p in ((3, 10, 0.4), (0, 5, 0.2), (10, 10, 0.9), (60, 100, 0.5)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        assert stats.binomial_tail(k, n, p) == pytest.approx(want)


def test_bootstrap(spark):
    df = spark.createDataFrame(cells("x", 60, 20, 400, 200), "label string, ref boolean, cmp boolean")
    r = stats.paired_bootstrap(df, ["label"], times=2000).first()
    assert r.ci_low < -0.1 < r.ci_high and -0.16 < r.ci_low and r.ci_high < -0.04
    assert stats.paired_bootstrap(df.repartition(7), ["label"], times=2000).first() == r


def test_flips_and_proxy(spark):
    rows = [("g", "A", "B", "A")] * 40 + [("g", "B", "A", "A")] * 5 + [("g", "A", "A", "A")] * 55 + [("h", "A", "B", "A")] * 3
    df = spark.createDataFrame(rows, "g string, ref_pred string, cmp_pred string, gold string")
    assert [(r.g, r.n, r.n_flip) for r in stats.flip_by_group(df, "g").collect()] == [("g", 100, 45)]
    top = stats.flip_directions(df.filter("g = 'g'"), ["g"]).orderBy("rank").collect()
    assert [(r.direction, r.n) for r in top] == [("A->B", 40), ("B->A", 5)]
    v = {r.g: r for r in stats.validate_proxy(df, ["g"]).collect()}
    assert (v["g"].flip_down, v["g"].flip_up) == (40, 5) and v["h"].verdict == "too few changes"


def test_paired_significance(spark):
    rows = [("m", p, i, (i + k) % 3 > 0) for k, p in enumerate(("bf16", "int8")) for i in range(60)] + [("m", "int4", i, True) for i in range(10)]
    df = spark.createDataFrame(rows, "model string, precision string, item_id int, ok boolean")
    got = {r.precision: r for r in stats.paired_significance(df, times=200).collect()}
    assert got["int8"].note is None and got["int8"].n == 60 and got["int4"].p_value is None and got["int4"].note


def test_agreement(spark):
    # Raw agreement .97 with skewed categories.
    rows = [("x", "1", "1")] * 92 + [("x", "0", "0")] * 5 + [("x", "1", "0")] * 3
    got = A.agreement(spark.createDataFrame(rows, "k string, a string, b string"), ["k"]).first()
    pi = ((95 + 92) / 2) / 100
    pe = 2 * pi * (1 - pi)
    assert got.ac1 == pytest.approx((0.97 - pe) / (1 - pe)) and got.ac1 > got.kappa and got.n_categories == 2
    assert round(got.ac1, 4) == 0.9658 and round(got.kappa, 4) == 0.7541
    one = A.agreement(spark.createDataFrame([("x", "1", "1")] * 4, "k string, a string, b string"), ["k"]).first()
    assert (one.ac1, one.kappa) == (1.0, 1.0)
    x = np.array([[92, 3, 0, 5]])
    assert A.ac1_of(x)[0] == pytest.approx(got.ac1) and A.kappa_of(x)[0] == pytest.approx(got.kappa)


def test_quotas_step_by_step():
    """Against the rule taken one row at a time."""
    import random

    rng = random.Random(1)
    for _ in range(300):
        sizes = {f"s{i}": rng.randint(1, 60) for i in range(rng.randint(1, 9))}
        target, least = rng.randint(1, 120), rng.randint(0, 6)
        got = S.quotas(sizes, target, least)
        total = sum(sizes.values())
        if target >= total:
            assert got == sizes
            continue
        want = {s: min(n, max(least, round(target * n / total))) for s, n in sizes.items()}
        while sum(want.values()) > target and (free := [s for s in sorted(want) if want[s] > min(least, sizes[s])]):
            want[sorted(free, key=lambda s: -want[s])[0]] -= 1
        while sum(want.values()) < target:
            want[sorted((s for s in sorted(want) if want[s] < sizes[s]), key=lambda s: want[s] / sizes[s])[0]] += 1
        assert got == want


def test_quotas():
    sizes = {f"s{i}": 20 + 7 * i for i in range(58)}
    q = S.quotas(sizes, 2000)
    assert sum(q.values()) == 2000 and set(q) == set(sizes) and all(5 <= q[s] <= n for s, n in sizes.items())
    assert S.quotas({"a": 2, "b": 1000}, 50) == {"a": 2, "b": 48}
    assert S.quotas({"a": 3}, 10) == {"a": 3}


def test_sample_ignores_partitions(spark):
    df = spark.range(1000).withColumn("s", (F.col("id") % 7).cast("string"))
    a = {r.id for r in S.stratified_sample(df, "s", "id", 100).collect()}
    b = {r.id for r in S.stratified_sample(df.repartition(5), "s", "id", 100).collect()}
    assert a == b and len(a) == 100
    cov = S.coverage(df.filter(F.col("id").isin(*a)), df, "s")
    assert cov.agg(F.max("share_deviation")).first()[0] < 0.02


def test_class_mix(spark):
    df = spark.range(500).withColumn("legal", F.col("id") < 100)
    got = S.class_mix(df, "id", "legal", n=100)
    assert got.count() == 100 and got.filter("legal").count() == 70
    assert S.class_mix(df.filter("legal"), "id", "legal", n=50).count() == 50


def test_latency_and_machines(spark):
    df = spark.createDataFrame([("t", float(i), float(i + 100), 11) for i in range(1, 21)], "tag string, ttft_ms double, total_ms double, n_output_tokens int")
    r = stats.latency_summary(df, "tag").first()
    assert (r.n_runs, r.ttft_ms_median, r.ttft_ms_p95, r.tpot_ms_median, r.tokens_per_s_median) == (20, 10.5, 20.0, 10.0, 100.0)
    m = spark.createDataFrame([("a", "x", "g1"), ("a", "y", "g2"), ("b", "x", "g1"), ("b", "y", "g1"), ("c", "x", None)], "model string, precision string, machine string")
    assert [tuple(r) for r in stats.mixed_machines(m).collect()] == [("a", 2, "g1,g2")]


def test_exact_ranks(spark):
    """Against sorting, for groups of any size, ties and few values."""
    import random

    rng = random.Random(8)
    groups = {"a": [1.0], "b": [2.0, 1.0], "c": [rng.choice((1.0, 2.0)) for _ in range(301)], "d": [rng.random() for _ in range(3000)], "e": [5.0] * 40 + [rng.random() for _ in range(7)]}
    df = spark.createDataFrame([(g, "m", v) for g, vs in groups.items() for v in vs], "g string, measure string, value double")
    n = F.col("n")
    ranks = {"low": (0.5, F.floor((n - 1) / 2)), "high": (0.5, F.floor(n / 2)), "p95": (0.95, F.least(n - 1, F.floor(0.95 * n))), "least": (0.0, n * 0), "most": (1.0, n - 1)}
    got = {(r.g, r.name): r.value for r in stats.exact_ranks(df, ["g"], ranks).collect()}
    for g, vs in groups.items():
        s, k = sorted(vs), len(vs)
        assert [got[g, x] for x in ("low", "high", "p95", "least", "most")] == [s[(k - 1) // 2], s[k // 2], s[min(k - 1, int(0.95 * k))], s[0], s[-1]]
