"""The whole comparison of two sides: outcomes, pairing, intervals, decisions, health, status."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decisions import improvement, noninferior, regression, severity, worst
from ..functions.values import is_finite, metric_higher_is_better
from .pairing import paired_differences, paired_observations, pairing_quality
from .statistics import bootstrap


def _per_name(name: Column, values: Mapping[str, float], default: float = 0.0) -> Column:
    out = F.lit(float(default))
    for key, v in values.items():
        out = F.when(name == key, F.lit(float(v))).otherwise(out)
    return out


def run_health(runs: DataFrame, side: str = "side", status: str = "status", run: str = "run_id") -> DataFrame:
    """Per side: any_failed, any_incomplete, failed_runs (sorted)."""
    failed = F.col(status).isin("failed", "error")
    incomplete = F.coalesce(~F.col(status).isin("failed", "error", "completed", "succeeded", "ok"), F.lit(True))
    return runs.groupBy(side).agg(F.bool_or(F.coalesce(failed, F.lit(False))).alias("any_failed"), F.bool_or(incomplete).alias("any_incomplete"), F.array_sort(F.collect_set(F.when(failed, F.col(run)))).alias("failed_runs"))


def group_parity(members: DataFrame, by: list[str], passed: str = "parity") -> DataFrame:
    """False if any member failed, else null if any is unknown, else true."""
    p = F.col(passed)
    return members.groupBy(*by).agg(F.when(F.bool_or(F.coalesce(~p, F.lit(False))), F.lit(False)).when(F.count_if(p.isNull()) == 0, F.lit(True)).alias("parity"))


def compare(baseline: DataFrame, candidate: DataFrame, thresholds: Mapping[str, float] | None = None, margins: Mapping[str, float] | None = None, directions: Mapping[str, bool] | None = None, resamples: int = 2000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """One row per metric name of name, token, value tables: quality counters, estimate, interval, decisions, status.

    Pairing is by identity; a group with repeated or missing identities gives no pairs and so no decision. Missing
    or insufficient evidence is inconclusive, never a pass.
    """
    by = ["name"]
    quality = pairing_quality(baseline, candidate, by)
    pairs = paired_differences(paired_observations(baseline, candidate, by))
    stats = bootstrap(pairs, by, ["token"], "difference", resamples, seed, confidence)
    higher = metric_higher_is_better(F.col("name"), directions)
    t, m = _per_name(F.col("name"), thresholds or {}), _per_name(F.col("name"), margins or {})
    out = quality.join(stats, by, "left").withColumns({"higher_is_better": higher, "threshold": t})
    args = (F.col("lower"), F.col("upper"), F.col("higher_is_better"))
    enough = F.coalesce(F.col("n") >= 2, F.lit(False))
    bad = enough & regression(F.col("estimate"), *args, F.col("threshold"))
    good = enough & improvement(F.col("estimate"), *args, F.col("threshold"))
    safe = enough & noninferior(*args, m)
    status = (
        F.when(bad, "fail").when(~enough | F.col("candidate_missing") | F.col("baseline_missing"), "inconclusive").when(F.lit(bool(margins)) & (m > 0) & ~safe, "fail").when((F.col("candidate_nonfinite") > 0) | (F.col("baseline_nonfinite") > 0), "warn").otherwise("pass")
    )
    return out.withColumns({"regression": bad, "improvement": good, "insufficient": ~(bad | good), "noninferior": safe, "status": status})


def overall(statuses: DataFrame, status: str = "status") -> DataFrame:
    """The gravest status of all, inconclusive if there are none."""
    return statuses.agg(F.coalesce(worst(F.max(severity(F.col(status)))), F.lit("inconclusive")).alias("status"), F.count(F.lit(1)).alias("items"))


def finite_share(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(is_finite(F.col(value)).cast("double")).alias("finite_share"))
