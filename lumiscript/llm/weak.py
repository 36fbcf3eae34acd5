"""A label model for noisy labelling functions, fitted by expectation-maximization.

A labelling function is a column that is 1 (the defect), 0 (no defect) or null
(abstains). Rows are counted by their pattern of votes with a map-side
aggregate; the patterns are few, at most 3 to the number of functions, and that
bound is checked before they are collected. EM then estimates the rate of the
defect and, for each function, how often it votes each way given the truth, so
abstaining tells something too. The posterior of a row is a sum of logarithms
in the plan: no join and no UDF.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumiscript.llm.common import bounded_rows


@dataclass
class LabelModel:
    """prior: rate of the defect; odds[f] = log odds that votes 0, 1 and abstaining of function f give."""

    votes: list[str]
    prior: float
    odds: list[tuple[float, float, float]]
    accuracy: list[tuple[float, float]]  # P(vote 1 | defect, votes), P(vote 0 | none, votes)

    def posterior(self) -> Column:
        z = F.lit(math.log(self.prior / (1 - self.prior)))
        for v, (zero, one, none) in zip(self.votes, self.odds):
            z = z + F.when(F.col(v) == 1, one).when(F.col(v) == 0, zero).otherwise(none)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit_patterns(patterns: np.ndarray, counts: np.ndarray, votes: list[str], prior: float = 0.1, trust: float = 0.9, strength: float = 20.0, rounds: int = 100) -> LabelModel:
    """EM over distinct patterns (-1 for abstaining) with their counts.

    ``trust`` is the prior belief that a vote is right, worth ``strength``
    votes; it keeps the classes from being swapped.
    """
    n, m = patterns.shape
    total = max(1.0, counts.sum())
    rate = [np.array([(patterns[:, f] == v) @ counts for v in (0, 1, -1)]) / total for f in range(m)]
    seen = [(patterns[:, f][:, None] == np.array([0, 1, -1])[None, :]).astype(float) for f in range(m)]
    # p[f][y] = chances of votes 0, 1, abstaining
    p = []
    for f in range(m):
        active = min(max(1 - rate[f][2], 1e-3), 0.999)
        p.append(np.array([[active * trust, active * (1 - trust), 1 - active], [active * (1 - trust), active * trust, 1 - active]]))
    belief = [x.copy() * strength for x in p]
    pi = prior
    for _ in range(rounds):
        z = np.full(n, math.log(pi / (1 - pi)))
        for f in range(m):
            z += seen[f] @ np.log(p[f][1] / p[f][0])
        q = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        w1, w0 = q * counts, (1 - q) * counts
        new = min(max((w1.sum() + prior * strength) / (total + strength), 1e-5), 1 - 1e-5)
        for f in range(m):
            for y, w in ((0, w0), (1, w1)):
                c = w @ seen[f] + belief[f][y] + 1e-3
                p[f][y] = c / c.sum()
        if abs(new - pi) < 1e-9:
            break
        pi = new
    odds = [tuple(float(x) for x in np.log(p[f][1] / p[f][0])) for f in range(m)]
    accuracy = [(float(p[f][1][1] / (p[f][1][0] + p[f][1][1])), float(p[f][0][0] / (p[f][0][0] + p[f][0][1]))) for f in range(m)]
    return LabelModel(votes, float(pi), odds, accuracy)


def fit_label_model(df: DataFrame, votes: list[str], prior: float = 0.1, trust: float = 0.9) -> LabelModel:
    rows = bounded_rows(df.groupBy(*[F.col(v).cast("int").alias(v) for v in votes]).count(), 3 ** len(votes), "the table of vote patterns")
    if not rows:
        return fit_patterns(np.zeros((1, len(votes)), int) - 1, np.zeros(1), votes, prior, trust)
    rows.sort(key=lambda r: tuple(-1 if r[v] is None else r[v] for v in votes))
    patterns = np.array([[-1 if r[v] is None else r[v] for v in votes] for r in rows])
    return fit_patterns(patterns, np.array([r["count"] for r in rows], float), votes, prior, trust)
