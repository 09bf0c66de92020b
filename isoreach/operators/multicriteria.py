"""Choquet integrals and outranking classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Indifference, preference, cut, class bounds and names.
Q, P, CUT = 0.02, 0.06, 0.75
BOUNDS = [0.35, 0.51, 0.66, 0.80]
CLASSES = ["Very Low", "Low", "Medium", "High", "Very High"]
# Fixed values for housing: class bounds in square metres, thresholds, residual income and class names.
HOUSING_BOUNDS, HOUSING_Q, HOUSING_P = [20.0, 28.0, 42.0, 56.0], 2.0, 6.0
HOUSING_RESIDUAL = 500.0
HOUSING_CLASSES = ["Q1", "Q2", "Q3", "Q4", "Q5"]


def midpoints(bounds: list[float] = BOUNDS) -> list[float]:
    edges = [0.0, *bounds, 1.0]
    return [(a + b) / 2 for a, b in zip(edges, edges[1:])]


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def choquet(xs: list[Column], single: list[float], pairs: dict[tuple[int, int], float]) -> Column:
    """The normalised 2-additive Choquet integral: singles times values, plus interactions times the lesser of each pair.

    Inputs and result are clamped to 0 and 1; a capacity of 0 or less gives 0.
    """
    x = [clamp(F.coalesce(v, F.lit(0.0))) for v in xs]
    full = sum(single) + sum(pairs.values())
    if full <= 0:
        return F.lit(0.0)
    total = sum((F.lit(m) * v for m, v in zip(single, x)), F.lit(0.0)) + sum((F.lit(i) * F.least(x[a], x[b]) for (a, b), i in pairs.items()), F.lit(0.0))
    return clamp(total / full)


def choquet_max(xs: list[Column], levels: list[float]) -> Column:
    """The Choquet integral for the measure that gives a set the largest level of its members, by the values in rising order."""
    both = F.array_sort(F.array(*(F.struct(x.alias("x"), F.lit(float(v)).alias("v")) for x, v in zip(xs, levels))))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("prev"), both.alias("tail"))

    def step(acc, s):
        top = F.array_max(F.transform(acc["tail"], lambda t: t["v"]))
        return F.struct((acc["total"] + (s["x"] - acc["prev"]) * top).alias("total"), s["x"].alias("prev"), F.slice(acc["tail"], F.lit(2), F.size(acc["tail"])).alias("tail"))

    return F.aggregate(both, start, step, lambda acc: acc["total"])


def credibility(xs: list[Column], weights: list[float], bound: float | Column, q: float | Column = Q, p: float | Column = P, veto: float | None = None) -> Column:
    """How far the values outrank a bound: weighted concordance, cut down by criteria that fall short by more than p, to 0 beyond the veto."""
    b = F.lit(bound) if isinstance(bound, (int, float)) else bound
    q = F.lit(q) if isinstance(q, (int, float)) else q
    p = F.lit(p) if isinstance(p, (int, float)) else p
    one = lambda x: F.when(x - b >= -q, F.lit(1.0)).when(x - b > -p, (x - b + p) / (p - q)).otherwise(F.lit(0.0))
    total = sum(weights)
    c = sum((F.lit(w) * one(x) for w, x in zip(weights, xs)), F.lit(0.0)) / total
    if veto is None:
        return c
    out = c
    for x in xs:
        short = (b - x - p) / (F.lit(veto) - p)
        out = F.when(b - x > veto, F.lit(0.0)).when((b - x > p) & (short > c), out * (1 - short) / (1 - c)).otherwise(out)
    return F.when(c < 1.0, out).otherwise(c)


def _spread(xs: list[Column]) -> Column:
    n = len(xs)
    mean = sum(xs[1:], xs[0]) / n
    return F.sqrt(sum((F.pow(x - mean, 2) for x in xs[1:]), F.pow(xs[0] - mean, 2)) / n)


def outrank_class(xs: list[Column], weights: list[float], bounds: list[float] = BOUNDS, q=Q, p=P, cut=CUT, veto: float | None = None, constant: bool = True) -> Column:
    """The class from 0: one above the last bound that is outranked. Equal values have no thresholds and go by the bounds they reach."""
    cut = F.lit(cut) if isinstance(cut, (int, float)) else cut
    by_rank = F.greatest(F.lit(0), *(F.when(credibility(xs, weights, b, q, p, veto) >= cut, k + 1).otherwise(0) for k, b in enumerate(bounds)))
    if not constant:
        return by_rank
    reached = sum((F.when(xs[0] >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    return F.when(_spread(xs) < 1e-9, reached).otherwise(by_rank)


def class_score(cls: Column, bounds: list[float] = BOUNDS) -> Column:
    return F.element_at(F.array(*map(F.lit, midpoints(bounds))), cls + 1)


def mean_credibility(xs: list[Column], weights: list[float], bounds: list[float] = BOUNDS, q=Q, p=P, veto: float | None = None) -> Column:
    """The mean credibility over the bounds; equal values get their class's midpoint."""
    own = sum((credibility(xs, weights, b, q, p, veto) for b in bounds), F.lit(0.0)) / len(bounds)
    return F.when(_spread(xs) < 1e-9, class_score(outrank_class(xs, weights, bounds, q, p, CUT, veto), bounds)).otherwise(own)
