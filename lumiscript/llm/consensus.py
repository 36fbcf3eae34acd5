"""Problem 2: one consensus from several annotators' labels.

Latent ability and difficulty: an annotator gives the right answer to item i of
code c with chance sigmoid(ability * ease), where the ability belongs to the
annotator, the code and the true state (true or false), and the ease to the
item and code. Gradient expectation-maximisation: a pass over the judgements
computes the posterior of each item and code and moves its ease along the
gradient, both from the abilities alone, so no state of items is kept between
passes; it sums the gradients and curvatures of the abilities within each
partition, and a Newton step on their totals updates the abilities.

The judgements are partitioned by item and written down once. What a pass
brings back is a row for each annotator, code and state, whose number is
checked (``max_annotators``); a hot annotator is summed within each partition
first, and an item has at most one judgement of each annotator.

Codes of an exclusive group (the question types) compete: exactly one of an
item is true, the first by name where two are equal.

Defined results: null maps, null values, items without id or tag and blank
annotators don't count; of an annotator's judgements of an item the last
stands; exact duplicates count once; an item whose votes are all abstentions
has no row.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumiscript.llm.common import bounded_rows, checkpointed

CENTRE, SPREAD = 2.0, 1.0  # prior of the abilities
#: Prior of the logarithm of the ease; an item has few judgements, so it is tight.
EASE_SPREAD = 0.15


def annotator_name(c: Column) -> Column:
    """One spelling of an annotator: without white space, in capitals; null for a blank one."""
    return F.nullif(F.upper(F.regexp_replace(c, r"(?U)[\s\x{200B}-\x{200F}\x{FEFF}]+", "")), F.lit(""))


def judgements(labels: DataFrame) -> DataFrame:
    """id, tag, annotator, code, vote: the last judgement of each annotator on each item and code."""
    name = annotator_name(F.col("annotator"))
    rows = labels.select("id", "tag", name.alias("annotator"), "labels", "labelled_at").filter("id IS NOT NULL AND tag IS NOT NULL AND annotator IS NOT NULL AND labels IS NOT NULL")
    order = F.struct("labelled_at", F.to_json("labels"))
    last = rows.groupBy("id", "tag", "annotator").agg(F.max_by("labels", order).alias("labels"))
    return last.select("id", "tag", "annotator", F.explode("labels").alias("code", "vote")).filter("vote IS NOT NULL AND code IS NOT NULL")


@dataclass
class Abilities:
    annotators: list[str]
    codes: list[str]
    exclusive: np.ndarray  # by code
    ability: np.ndarray  # annotator, code, state
    prior: np.ndarray  # by code
    ease_spread: float = EASE_SPREAD


def posteriors(m: Abilities, item: np.ndarray, code: np.ndarray, who: np.ndarray, vote: np.ndarray, steps: int = 3):
    """For votes sorted by item and code: starts of the pairs, posterior and ease of each pair.

    The posterior and the ease take turns, each from the other.
    """
    start = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (code[1:] != code[:-1])])
    pair = np.cumsum(np.r_[False, (item[1:] != item[:-1]) | (code[1:] != code[:-1])].astype(np.int64))
    a1, a0 = m.ability[who, code, 1], m.ability[who, code, 0]
    own = code[start]
    base = np.log(m.prior[own] / (1 - m.prior[own]))
    group_start = np.flatnonzero(np.r_[True, item[start][1:] != item[start][:-1]])
    group = np.cumsum(np.r_[False, item[start][1:] != item[start][:-1]].astype(np.int64))
    competing = m.exclusive[own]
    log_ease = np.zeros(len(start))
    sign = np.where(vote, 1.0, -1.0)
    q = None
    for k in range(steps):
        e = np.exp(log_ease)[pair]
        # log P(vote | true) - log P(vote | false)
        ratio = -np.logaddexp(0, -sign * a1 * e) + np.logaddexp(0, sign * a0 * e)
        z = base + np.add.reduceat(ratio, start)
        q = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        if competing.any():
            top = np.maximum.reduceat(z, group_start)[group]
            w = np.exp(np.clip(z - top, -50, 0))
            q = np.where(competing, w / np.add.reduceat(w, group_start)[group], q)
        if k < steps - 1:
            p1, p0 = 1 / (1 + np.exp(-a1 * e)), 1 / (1 + np.exp(-a0 * e))
            qv = q[pair]
            g = qv * (vote - p1) * a1 * e + (1 - qv) * ((1 - vote) - p0) * a0 * e
            h = qv * p1 * (1 - p1) * (a1 * e) ** 2 + (1 - qv) * p0 * (1 - p0) * (a0 * e) ** 2
            step = (np.add.reduceat(g, start) - log_ease / m.ease_spread**2) / (np.add.reduceat(h, start) + 1 / m.ease_spread**2)
            log_ease = np.clip(log_ease + np.clip(step, -0.5, 0.5), -1.5, 1.5)
    return start, pair, q, np.exp(log_ease)


def whole(batches) -> pd.DataFrame | None:
    """A partition as one frame in order; partitions hold whole items."""
    parts = [b for b in batches if len(b)]
    return pd.concat(parts, ignore_index=True) if parts else None


def prepared(votes: DataFrame, exclusive_tag: str | None, max_annotators: int, ease_spread: float = EASE_SPREAD) -> tuple[DataFrame, Abilities]:
    counts = votes.groupBy("annotator", "code", (F.col("tag").eqNullSafe(F.lit(exclusive_tag))).alias("x")).agg(F.avg(F.col("vote").cast("double")).alias("rate"), F.count("*").alias("n"))
    rows = bounded_rows(counts, max_annotators, "the table of annotators and codes")
    who, codes = sorted({r.annotator for r in rows}), sorted({r.code for r in rows})
    exclusive = np.array([any(r.x for r in rows if r.code == c) for c in codes], bool)
    n = np.array([sum(r.n for r in rows if r.code == c) for c in codes], float)
    prior = np.array([sum(r.n * r.rate for r in rows if r.code == c) for c in codes]) / np.maximum(n, 1)
    model = Abilities(who, codes, exclusive, np.full((len(who), len(codes), 2), CENTRE), np.clip(prior, 0.01, 0.99), ease_spread)
    # Numbers instead of names, from maps whose size the check above bounds.
    spark = votes.sparkSession
    small = lambda names, key, no: F.broadcast(spark.createDataFrame(pd.DataFrame({key: pd.Series(names, dtype="object"), no: np.arange(len(names), dtype=np.int64)}), f"{key} string, {no} bigint"))
    numbered = votes.join(small(who, "annotator", "a"), "annotator").join(small(codes, "code", "c"), "code")
    rows = numbered.select("id", "tag", "c", "a", F.col("vote").cast("int").alias("v")).repartition("id", "tag").sortWithinPartitions("id", "tag", "c", "a")
    return checkpointed(rows), model


def item_numbers(pdf: pd.DataFrame) -> np.ndarray:
    i, t = pdf["id"].to_numpy(), pdf["tag"].to_numpy()
    return np.cumsum(np.r_[False, (i[1:] != i[:-1]) | (t[1:] != t[:-1])].astype(np.int64)) if len(pdf) else np.zeros(0, np.int64)


def fit_abilities(rows: DataFrame, model: Abilities, passes: int = 15, tolerance: float = 0.01) -> Abilities:
    spark = rows.sparkSession
    shape = model.ability.shape
    for _ in range(passes):
        if not shape[0]:
            break
        bc = spark.sparkContext.broadcast(model)

        def one(batches):
            m = bc.value
            pdf = whole(batches)
            if pdf is None:
                return
            who, code, vote = pdf["a"].to_numpy(np.int64), pdf["c"].to_numpy(np.int64), pdf["v"].to_numpy(float)
            start, pair, q, ease = posteriors(m, item_numbers(pdf), code, who, vote)
            e, qv = ease[pair], q[pair]
            size = int(np.prod(shape[:2]))
            at = who * shape[1] + code
            parts = []
            for state, weight, right in ((0, 1 - qv, 1 - vote), (1, qv, vote)):
                p = 1 / (1 + np.exp(-m.ability[who, code, state] * e))
                g, h, w = (np.bincount(at, x, size) for x in (weight * (right - p) * e, weight * p * (1 - p) * e * e, weight))
                seen = np.flatnonzero(w)
                parts.append(pd.DataFrame({"k": seen * 2 + state, "g": g[seen], "h": h[seen]}))
            n = np.bincount(code[start], minlength=shape[1])
            total = np.bincount(code[start], q, shape[1])
            seen = np.flatnonzero(n)
            parts.append(pd.DataFrame({"k": -1 - seen, "g": total[seen], "h": n[seen].astype(float)}))
            yield pd.concat(parts)

        sums = rows.mapInPandas(one, "k bigint, g double, h double").groupBy("k").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        got = bounded_rows(sums, 2 * int(np.prod(shape)) + shape[1], "the sums of the abilities")
        new, prior = model.ability.copy().reshape(-1), model.prior.copy()
        for r in sorted(got, key=lambda r: r.k):
            if r.k < 0:
                prior[-1 - r.k] = np.clip((r.g + 1) / (r.h + 10), 0.005, 0.995) if not model.exclusive[-1 - r.k] else np.clip(r.g / r.h, 0.02, 0.98)
            else:
                step = (r.g - (new[r.k] - CENTRE) / SPREAD**2) / (r.h + 1 / SPREAD**2)
                new[r.k] += np.clip(step, -1.0, 1.0)
        new = np.clip(new, -6, 8).reshape(shape)
        change = np.abs(new - model.ability).max()
        model = replace(model, ability=new, prior=prior)
        if change < tolerance:
            break
    return model


def consensus(labels: DataFrame, exclusive_tag: str | None = "qa", max_annotators: int = 200_000, passes: int = 15, ease_spread: float = EASE_SPREAD) -> tuple[DataFrame, DataFrame]:
    """(labels of items, reliability of annotators).

    The first: id, tag, code, posterior, difficulty, n_votes, holds. The second:
    annotator, code, sensitivity, specificity (at an item of mean ease).
    """
    votes = judgements(labels)
    rows, model = prepared(votes, exclusive_tag, max_annotators, ease_spread)
    model = fit_abilities(rows, model, passes)
    spark = labels.sparkSession
    bc = spark.sparkContext.broadcast(model)

    def last(batches):
        m = bc.value
        pdf = whole(batches)
        if pdf is None:
            return
        who, code, vote = pdf["a"].to_numpy(np.int64), pdf["c"].to_numpy(np.int64), pdf["v"].to_numpy(float)
        item = item_numbers(pdf)
        start, pair, q, ease = posteriors(m, item, code, who, vote)
        n = np.diff(np.r_[start, len(pdf)])
        holds = q >= 0.5
        first = np.flatnonzero(np.r_[True, item[start][1:] != item[start][:-1]])
        group = np.cumsum(np.r_[False, item[start][1:] != item[start][:-1]].astype(np.int64))
        top = np.maximum.reduceat(q, first)[group]
        is_top = q == top
        before = np.cumsum(is_top) - np.r_[0, np.cumsum(is_top)][first][group]
        own = m.exclusive[code[start]]
        holds = np.where(own, is_top & (before == 1), holds)
        yield pd.DataFrame({"id": pdf["id"].to_numpy()[start], "tag": pdf["tag"].to_numpy()[start], "code": np.array(m.codes, object)[code[start]], "posterior": q, "difficulty": 1 / ease, "n_votes": n, "holds": holds})

    items = rows.mapInPandas(last, "id string, tag string, code string, posterior double, difficulty double, n_votes bigint, holds boolean")
    chance = 1 / (1 + np.exp(-model.ability))
    table = pd.DataFrame([(a, c, float(chance[i, j, 1]), float(chance[i, j, 0])) for i, a in enumerate(model.annotators) for j, c in enumerate(model.codes)], columns=["annotator", "code", "sensitivity", "specificity"])
    return items, spark.createDataFrame(table, "annotator string, code string, sensitivity double, specificity double")


def agreement(labels: DataFrame) -> DataFrame:
    """code, n_items, n_votes, observed, kappa (Fleiss), ac1 (Gwet): chance-corrected agreement over items with two votes or more."""
    votes = judgements(labels)
    per = votes.groupBy("id", "tag", "code").agg(F.count("*").alias("n"), F.sum(F.col("vote").cast("bigint")).alias("t")).filter("n >= 2")
    per = per.withColumn("agree", (F.col("t") * (F.col("t") - 1) + (F.col("n") - F.col("t")) * (F.col("n") - F.col("t") - 1)) / (F.col("n") * (F.col("n") - 1)))
    by = per.groupBy("code").agg(F.count("*").alias("n_items"), F.sum("n").alias("n_votes"), F.avg("agree").alias("po"), F.avg(F.col("t") / F.col("n")).alias("p"), (F.sum("t") / F.sum("n")).alias("w"))
    pe, pg = F.col("w") * F.col("w") + (1 - F.col("w")) * (1 - F.col("w")), 2 * F.col("p") * (1 - F.col("p"))
    corrected = lambda e: F.when(e >= 1, F.lit(1.0)).otherwise((F.col("po") - e) / (1 - e))
    return by.select("code", "n_items", F.col("n_votes").cast("bigint").alias("n_votes"), F.round("po", 6).alias("observed"), F.round(corrected(pe), 6).alias("kappa"), F.round(corrected(pg), 6).alias("ac1"))
