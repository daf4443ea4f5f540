"""Decisions from intervals, as column expressions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import is_finite

#: From mildest to gravest.
SEVERITY = ("pass", "warn", "inconclusive", "fail")


def wilson(successes: Column, total: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, clamped to [0, 1]; null for no trials."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    n = F.when(total > 0, total.cast("double"))
    p = successes / n
    scale = 1 + F.lit(z * z) / n
    centre = (p + F.lit(z * z) / (2 * n)) / scale
    radius = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n)) / scale
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), centre - radius)), F.when(n.isNotNull(), F.least(F.lit(1.0), centre + radius))


def _usable(*values: Column) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & is_finite(v)
    return out


def regression(delta: Column, low: Column, high: Column, higher: Column, threshold: Column) -> Column:
    """The whole interval lies beyond the threshold on the harmful side."""
    harm = F.when(higher, high < -F.abs(threshold)).otherwise(low > F.abs(threshold))
    return F.when(_usable(delta, low, high), harm).otherwise(F.lit(False))


def improvement(delta: Column, low: Column, high: Column, higher: Column, threshold: Column) -> Column:
    gain = F.when(higher, low > F.abs(threshold)).otherwise(high < -F.abs(threshold))
    return F.when(_usable(delta, low, high), gain).otherwise(F.lit(False))


def noninferior(low: Column, high: Column, higher: Column, margin: Column) -> Column:
    """The interval rules out harm beyond the margin; without a finite interval it doesn't."""
    return F.when(_usable(low, high), F.when(higher, low).otherwise(-high) >= -F.abs(margin)).otherwise(F.lit(False))


def ternary(low: Column, high: Column, n: Column, higher: Column, tolerance: Column, min_observations: int = 5) -> Column:
    """regression, no_regression or inconclusive; too few observations are inconclusive."""
    t = F.abs(tolerance)
    bad = F.when(higher, high < -t).otherwise(low > t)
    good = F.when(higher, low >= -t).otherwise(high <= t)
    return F.when((n < min_observations) | ~_usable(low, high), "inconclusive").when(bad, "regression").when(good, "no_regression").otherwise("inconclusive")


def severity(status: Column) -> Column:
    """The rank of a status, so that the worst of several is their maximum."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), status).cast("int")


def worst(rank: Column) -> Column:
    return F.when(rank.isNotNull(), F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), rank.cast("int")))
