"""Prediction changes between two models: flips, accuracy, class shift, calibration, slices."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed, numbered
from ..functions.decisions import wilson
from ..functions.values import argmax, confidence, values_differ
from .statistics import MAX_DRAWS

BINS = 10


def classes(df: DataFrame, baseline: str = "baseline", candidate: str = "candidate", label: str | None = "label") -> DataFrame:
    """Adds b_class, c_class, and with labels b_correct, c_correct, for score vectors or class columns."""
    own = lambda c: argmax(F.col(c)) if df.schema[c].dataType.typeName() == "array" else F.col(c)
    out = df.withColumns({"b_class": own(baseline), "c_class": own(candidate)})
    if label:
        out = out.withColumns({"b_correct": F.col("b_class").eqNullSafe(F.col(label)), "c_correct": F.col("c_class").eqNullSafe(F.col(label))})
    return out


def change_counts(df: DataFrame, by: Sequence[str] = (), baseline: str = "baseline", candidate: str = "candidate", label: str | None = "label", level: float = 0.95) -> DataFrame:
    """All counters of changed predictions in one aggregation, with a Wilson interval of the change rate."""
    rows = classes(df, baseline, candidate, label)
    flip = F.col("b_class") != F.col("c_class")
    differ = values_differ(F.col(baseline), F.col(candidate))
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(flip).alias("class_flips"), F.count_if(differ & ~flip).alias("confidence_only")]
    if label:
        aggs += [
            F.count_if(flip & F.col("b_correct") & ~F.col("c_correct")).alias("flips_to_incorrect"),
            F.count_if(flip & ~F.col("b_correct") & F.col("c_correct")).alias("flips_to_correct"),
            F.avg(F.col("b_correct").cast("double")).alias("baseline_accuracy"),
            F.avg(F.col("c_correct").cast("double")).alias("candidate_accuracy"),
        ]
    out = rows.groupBy(*by).agg(*aggs)
    low, high = wilson(F.col("class_flips"), F.col("n"), level)
    out = out.withColumns({"change_rate": F.col("class_flips") / F.col("n"), "change_low": low, "change_high": high})
    return out.withColumn("accuracy_delta", F.col("candidate_accuracy") - F.col("baseline_accuracy")) if label else out


def class_distribution(df: DataFrame, cls: str, by: Sequence[str] = ()) -> DataFrame:
    """by..., class, share."""
    counts = df.groupBy(*by, F.col(cls).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    if by:
        return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("total_"))), F.lit(True)).withColumn("share", F.col("n") / F.col("total_")).drop("total_")  # one row


def class_shift(df: DataFrame, baseline: str = "b_class", candidate: str = "c_class") -> DataFrame:
    """Total variation distance of the two class distributions."""
    b = class_distribution(df, baseline).select("class", F.col("share").alias("b"))
    c = class_distribution(df, candidate).select("class", F.col("share").alias("c"))
    gap = F.abs(F.coalesce("b", F.lit(0.0)) - F.coalesce("c", F.lit(0.0)))
    return b.join(c, "class", "full_outer").agg((F.sum(gap) / 2).alias("total_variation"))


def valid_scores(scores: Column) -> Column:
    """A probability vector: finite, within [0, 1], summing to 1 within 1e-3."""
    inside = F.forall(scores, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1))
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.coalesce((F.size(scores) > 0) & inside & (F.abs(total - 1) <= 1e-3), F.lit(False))


def calibration_error(df: DataFrame, scores: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """by..., n, ece over ten bins of confidence; a single invalid row voids the figure (null)."""
    c = confidence(F.col(scores)).cast("double")
    terms = df.select(*by, c.alias("conf"), (argmax(F.col(scores)) == F.col(label)).cast("double").alias("hit"), valid_scores(F.col(scores)).alias("ok"))
    terms = terms.withColumn("bin", F.least(F.lit(BINS - 1), F.floor(F.col("conf") * BINS)))
    bins = terms.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("m"), F.avg("conf").alias("conf"), F.avg("hit").alias("hit"), F.bool_and("ok").alias("ok"))
    gap = F.sum(F.col("m") * F.abs(F.col("conf") - F.col("hit"))) / F.sum("m")
    return bins.groupBy(*by).agg(F.sum("m").alias("n"), F.when(F.bool_and("ok"), gap).alias("ece"))


def _outcome(label: bool) -> list[Column]:
    if label:
        return [F.avg(F.col("b_correct").cast("double")).alias("baseline_score"), F.avg(F.col("c_correct").cast("double")).alias("candidate_score")]
    none = F.lit(None).cast("double")
    return [F.first(none).alias("baseline_score"), F.first(none).alias("candidate_score")]


def _delta(label: bool) -> Column:
    return F.col("candidate_score") - F.col("baseline_score") if label else F.lit(None).cast("double")


def categorical_slices(rows: DataFrame, columns: Sequence[str], min_support: int = 5, max_values: int = 50) -> DataFrame:
    """slice, feature, value, support, scores, delta of every value of every column, from one unpivoted aggregation.

    rows needs b_correct and c_correct. Of a column's values the max_values most frequent are looked at (ties by
    value), so the choice doesn't depend on row order.
    """
    cells = rows.select("b_correct", "c_correct", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])).alias("s"))
    found = cells.groupBy("s.feature", "s.value").agg(F.count(F.lit(1)).alias("support"), *_outcome(True))
    rank = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("support"), F.asc_nulls_first("value")))
    kept = found.withColumn("rank_", rank).where((F.col("rank_") <= max_values) & (F.col("support") >= min_support)).drop("rank_")
    return kept.select(F.concat_ws("=", "feature", F.coalesce("value", F.lit("null"))).alias("slice"), "feature", "value", "support", "baseline_score", "candidate_score", _delta(True).alias("delta"))


def numeric_slices(rows: DataFrame, column: str, bins: int = 4, min_support: int = 5) -> DataFrame:
    """Half-open ranges between the quantile cuts of a numeric column's distinct values (the last one closed).

    The cuts are exact: distinct values are numbered in order over range partitions, and those with the cuts' ranks
    are picked; no task sees them all.
    """
    values = rows.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)").distinct()
    placed = checkpointed(numbered(values, ["v"], "place"))
    kinds = placed.count()
    ranks = [max(0, math.ceil(i / bins * kinds) - 1) for i in range(bins + 1)]
    cut = {r.place: r.v for r in placed.where(F.col("place").isin(ranks)).collect()} if kinds > bins else {}
    out = "feature string, lower double, upper double, support long, baseline_score double, candidate_score double, delta double"
    if not cut:
        return rows.sparkSession.createDataFrame([], out)
    edges = [F.lit(cut[r]) for r in ranks]
    v = F.col(column).cast("double")
    number = sum(((v >= e).cast("int") for e in edges[1:-1]), F.lit(0))
    binned = rows.where(v.isNotNull() & ~F.isnan(v)).withColumns({"lower": F.element_at(F.array(*edges[:-1]), number + 1), "upper": F.element_at(F.array(*edges[1:]), number + 1)})
    found = binned.groupBy("lower", "upper").agg(F.count(F.lit(1)).alias("support"), *_outcome(True)).where(F.col("support") >= min_support)
    return found.select(F.lit(column).alias("feature"), "lower", "upper", "support", "baseline_score", "candidate_score", _delta(True).alias("delta"))


def pair_slices(rows: DataFrame, columns: Sequence[str], min_support: int = 5, max_values: int = 50) -> DataFrame:
    """Every pair of values of every two columns, by one aggregation over exploded pairs."""
    pairs = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(a).cast("string").alias("left_value"), F.col(b).cast("string").alias("right_value")) for a, b in combinations(sorted(columns), 2)]
    found = rows.select("b_correct", "c_correct", F.explode(F.array(*pairs)).alias("s")).groupBy("s.left", "s.right", "s.left_value", "s.right_value").agg(F.count(F.lit(1)).alias("support"), *_outcome(True))
    rank = F.row_number().over(Window.partitionBy("left", "right").orderBy(F.desc("support"), F.asc_nulls_first("left_value"), F.asc_nulls_first("right_value")))
    kept = found.withColumn("rank_", rank).where((F.col("rank_") <= max_values) & (F.col("support") >= min_support)).drop("rank_")
    return kept.withColumn("delta", _delta(True))


def worst_slices(slices: DataFrame, name: str = "slice", top: int = 20) -> DataFrame:
    """The slices that lost most: by delta, then support, then name."""
    return slices.orderBy(F.asc("delta"), F.desc("support"), F.asc(name)).limit(top)


def holm(p_values: DataFrame, by: Sequence[str] = (), p: str = "p_value") -> DataFrame:
    """Holm's step-down adjusted p-values per family."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    ordered = w.orderBy(F.col(p))
    step = (F.count(F.lit(1)).over(w) - F.row_number().over(ordered) + 1) * F.col(p)
    return p_values.withColumn("step_", step).withColumn("p_holm", F.least(F.lit(1.0), F.max("step_").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))).drop("step_")


def behaviour_decision(summary: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """regression where the candidate's accuracy interval lies below the threshold."""
    limit = F.lit(float(thresholds.get("accuracy", 0.0)))
    return summary.withColumn("regression", F.col("upper") < -limit)


def calibration_interval(df: DataFrame, baseline: str, candidate: str, label: str, row: str, resamples: int = 2000, seed: int = 0, level: float = 0.95, max_draws: int = MAX_DRAWS) -> DataFrame:
    """Interval of the difference of two models' calibration errors over shared resamples of the rows.

    Each row is reduced to its bins, confidences and hits once; resamples are drawn from those. Beyond max_draws rows
    times resamples, each row counts a hashed Poisson(1) number of times instead, without a join (see statistics).
    """
    from .statistics import indexed, interval, poisson_draw, resampled

    def terms(scores: str, p: str) -> list[Column]:
        c = confidence(F.col(scores)).cast("double")
        return [F.least(F.lit(BINS - 1), F.floor(c * BINS)).cast("int").alias(f"{p}_bin"), c.alias(f"{p}_conf"), (argmax(F.col(scores)) == F.col(label)).cast("double").alias(f"{p}_hit")]

    rows = df.select(F.lit(0).alias("g"), F.col(row).alias("row_"), F.struct(*terms(baseline, "b"), *terms(candidate, "c")).alias("t"))
    rows = checkpointed(rows)
    if rows.count() * resamples <= max_draws:
        drawn = resampled(indexed(rows, ["g"], ["row_"], "t"), ["g"], resamples, seed).withColumn("w", F.lit(1))
    else:
        drawn = poisson_draw(rows.withColumnRenamed("t", "value"), ["row_"], resamples, seed).where("w > 0")
    sides = drawn.select("r", "w", F.explode(F.array(*[F.struct(F.lit(s).alias("sign"), F.col(f"value.{p}_bin").alias("bin"), F.col(f"value.{p}_conf").alias("conf"), F.col(f"value.{p}_hit").alias("hit")) for p, s in (("b", -1.0), ("c", 1.0))])).alias("x"))
    mean = lambda c: (F.sum(F.col("w") * F.col(c)) / F.sum("w"))
    bins = sides.groupBy("r", "x.sign", "x.bin").agg(F.sum("w").alias("m"), mean("x.conf").alias("conf"), mean("x.hit").alias("hit"))
    per = bins.groupBy("r").agg((2 * F.sum(F.col("sign") * F.col("m") * F.abs(F.col("conf") - F.col("hit"))) / F.sum("m")).alias("s"))
    return interval(per, [], level)
