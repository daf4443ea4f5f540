"""Bootstrap by hashed resampling, effect sizes, interval decisions.

A resample's i-th draw is a hash of (seed, resample, i), so results don't depend on partitioning and SQL can repeat
them. Groups of up to SMALL_DRAWS rows times resamples are drawn by a join by (group, index) of so many rows. Larger ones
are drawn in workers that hold a group's packed values, up to MAX_VALUES of them; beyond that, and for statistics of the
caller's own, the join serves at any size. A caller who sets max_draws gets, for means and sums of groups with more draws,
rows weighed by a hashed Poisson(1) number instead. The exact engine repeats the stream of Python's generator for small
groups.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions.values import finite_or_null
from . import draws


#: Rows times resamples of a group up to which calibration_interval makes its draws one by one.
MAX_DRAWS = 50_000_000
#: Rows times resamples of the largest group up to which draws are rows of a join, and values that a worker holds.
SMALL_DRAWS, MAX_VALUES = 100_000, 16_000_000


def pick(seed: int, resample: Column, i: Column, n: Column) -> Column:
    """The index in [0, n) that draw i of a resample takes."""
    word = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), resample.cast("string"), i.cast("string"))), 1, 8)
    return F.pmod(F.conv(word, 16, 10).cast("long"), n.cast("long"))


def indexed(df: DataFrame, by: list[str], order: Sequence[str | Column], value: str) -> DataFrame:
    """by..., i (from 0 in the given order) and the group's size n, beside the value."""
    w = Window.partitionBy(*by)
    return df.select(*by, F.col(value).alias("value"), (F.row_number().over(w.orderBy(*order)) - 1).cast("long").alias("i"), F.count(F.lit(1)).over(w).alias("n"))


def resampled(rows: DataFrame, by: list[str], resamples: int, seed: int) -> DataFrame:
    """Each resample's drawn values: by..., r, value. Resamples are exploded from the rows, not from a cross join, and the
    join is by a shuffle: the exploded side's size is estimated without the explosion, so it could be broadcast."""
    drawn = rows.select(*by, "i", "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r"))
    drawn = drawn.select(*by, "r", pick(seed, F.col("r"), F.col("i"), F.col("n")).alias("i"))
    return drawn.join(rows.select(*by, "i", "value").hint("merge"), [*by, "i"]).select(*by, "r", "value")


#: Statistics by name, of the column of that name; p95 is the nearest rank.
AGGREGATES: dict[str, Callable[[str], Column]] = {
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "median": lambda c: F.percentile(c, 0.5),
    "p95": lambda c: F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY `{c}`)"),
}


def interval(statistics: DataFrame, by: list[str], confidence: float, statistic: str = "s") -> DataFrame:
    """Percentile bounds over the resamples (linear interpolation) and the two-sided p-value of zero."""
    tail = (1 - confidence) / 2
    below = F.avg(F.when(F.col(statistic) <= 0, 1.0).otherwise(0.0))
    return statistics.groupBy(*by).agg(F.percentile(statistic, tail).alias("lower"), F.percentile(statistic, 1 - tail).alias("upper"), F.least(F.lit(1.0), 2 * F.least(below, 1 - below)).alias("p_value"))


def aggregate_of(aggregate: str | Callable[[str], Column]) -> Callable[[str], Column]:
    """A statistic by its name, or the caller's own: a function from a column's name to an aggregate."""
    return AGGREGATES[aggregate] if isinstance(aggregate, str) else aggregate


def _statistics(df: DataFrame, by: list[str], order: Sequence[str | Column], value: str, resamples: int, seed: int, aggregate: str | Callable[[str], Column], max_draws: int | None) -> DataFrame:
    """by..., r, s: the statistic of each resample. df is written, as it is read several times."""
    largest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if max_draws is not None and largest * resamples > max_draws and aggregate in ("mean", "sum"):
        total = F.col("s") / F.col("w") if aggregate == "mean" else F.col("s")
        return draws.poisson_sums(df, by, order, value, resamples, seed).select(*by, "r", total.alias("s"))
    if largest * resamples > SMALL_DRAWS and largest <= MAX_VALUES and aggregate in draws.KINDS and df.schema[value].dataType.simpleString() == "double":
        return draws.drawn_statistics(df, by, order, value, resamples, seed, aggregate)
    return resampled(indexed(df, by, order, value), by, resamples, seed).groupBy(*by, "r").agg(aggregate_of(aggregate)("value").alias("s"))


def bootstrap(df: DataFrame, by: list[str], order: Sequence[str | Column], value: str, resamples: int = 2000, seed: int = 0, confidence: float = 0.95, aggregate: str | Callable[[str], Column] = "mean", max_draws: int | None = None) -> DataFrame:
    """by..., n, estimate, lower, upper, p_value of a statistic of one sample per group.

    Draws are made at any size. Only where max_draws is set, the mean or sum of groups with more than max_draws / resamples
    rows is bootstrapped by Poisson weights, keyed by the order columns.
    """
    rows = checkpointed(df)
    stats = _statistics(rows, by, order, value, resamples, seed, aggregate, max_draws)
    whole = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), aggregate_of(aggregate)(value).alias("estimate"))
    bounds = interval(stats, by, confidence)
    return whole.join(bounds, by) if by else whole.join(F.broadcast(bounds), F.lit(True))


def independent_bootstrap(baseline: DataFrame, candidate: DataFrame, by: list[str], order: Sequence[str | Column], value: str, resamples: int = 2000, seed: int = 0, confidence: float = 0.95, aggregate: str | Callable[[str], Column] = "mean", max_draws: int | None = None) -> DataFrame:
    """Interval of the difference of two samples' statistics over finite values, each drawn on its own; with the
    numbers of values, baseline_n and candidate_n, and of those left out. The two sides' statistics, groups * resamples rows,
    meet by a shuffle: their size is estimated from the rows drawn from, so they could be broadcast."""
    stats, wholes = None, []
    for side, df, offset in (("baseline", baseline, 0), ("candidate", candidate, 1)):
        rows = checkpointed(df.withColumn("finite_", finite_or_null(F.col(value))))
        own = _statistics(rows.where("finite_ IS NOT NULL"), by, order, "finite_", resamples, seed + offset, aggregate, max_draws).withColumnRenamed("s", side)
        stats = own if stats is None else stats.join(own.hint("merge"), [*by, "r"])
        wholes.append(rows.groupBy(*by).agg(aggregate_of(aggregate)("finite_").alias(side), F.count("finite_").alias(f"{side}_n"), F.count_if(F.col("finite_").isNull()).alias(f"{side}_left_out")))
    bounds = interval(stats.withColumn("s", F.col("candidate") - F.col("baseline")), by, confidence)
    both = wholes[0].join(wholes[1], by if by else F.lit(True))
    both = both.withColumn("delta", F.col("candidate") - F.col("baseline"))
    return both.join(bounds, by) if by else both.join(F.broadcast(bounds), F.lit(True))


def poisson_weight(u: Column) -> Column:
    """The Poisson(1) count whose distribution function first exceeds u in [0, 1), up to 9."""
    import math

    bounds = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(9)]
    out = F.lit(9)
    for k, bound in reversed(list(enumerate(bounds))):
        out = F.when(u < bound, k).otherwise(out)
    return out


def poisson_draw(df: DataFrame, key: Sequence[str | Column], resamples: int, seed: int) -> DataFrame:
    """df exploded by resample r, with the number of times w that the row counts in it."""
    keys = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key]
    word = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("r").cast("string"), *keys)), 1, 8)
    return df.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("w", poisson_weight(F.conv(word, 16, 10).cast("double") / F.lit(float(1 << 32))))


def poisson_bootstrap(df: DataFrame, by: list[str], key: str, value: str, resamples: int = 2000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """by..., n, estimate, lower, upper, p_value of a mean, for large samples.

    Each row counts in each resample a hashed Poisson(1) number of times instead of being drawn, an approximation
    that differs little once there are a few hundred rows. There is no join: weights are hashed and added up in workers,
    so what moves, besides each row once, is partial sums of groups * resamples rows.
    """
    stats = draws.poisson_sums(df, by, [key], value, resamples, seed).select(*by, "r", (F.col("s") / F.col("w")).alias("s"))
    whole = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("estimate"))
    bounds = interval(stats, by, confidence)
    return whole.join(bounds, by) if by else whole.join(F.broadcast(bounds), F.lit(True))


def effect_size(differences: DataFrame, by: list[str], value: str = "difference") -> DataFrame:
    """mean / sample deviation; with no deviation zero for a zero mean, else a signed infinity."""
    out = differences.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    still = F.when(F.col("mean") == 0, 0.0).when(F.col("mean") > 0, float("inf")).otherwise(float("-inf"))
    return out.withColumn("effect_size", F.when(F.col("n") < 2, F.lit(None).cast("double")).when(F.col("sd") == 0, still).otherwise(F.col("mean") / F.col("sd")))


def exact_bootstrap(df: DataFrame, by: list[str], order: list[str], value: str, resamples: int = 2000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """The mean's interval with the draws of random.Random(seed) in row order, for comparison with that generator.

    Every group is worked on in one task, so use it for small groups.
    """
    fields = df.select(*by).schema
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in fields] + ["n long", "estimate double", "lower double", "upper double"])

    def run(key: tuple, pdf: Any) -> Any:
        import pandas as pd

        values = pdf.sort_values(order)[value].tolist()
        rng, n = random.Random(seed), len(values)
        means = sorted(sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(resamples))

        def quantile(p: float) -> float:
            at = p * (len(means) - 1)
            low = int(at)
            high = min(low + 1, len(means) - 1)
            return means[low] + (means[high] - means[low]) * (at - low)

        tail = (1 - confidence) / 2
        return pd.DataFrame([[*key, n, sum(values) / n, quantile(tail), quantile(1 - tail)]], columns=[*by, "n", "estimate", "lower", "upper"])

    return df.groupBy(*by).applyInPandas(run, schema)
