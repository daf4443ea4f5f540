"""Ordered revisions: classification from paired scores or votes, first bad one, non-monotonic ones."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.decisions import ternary
from .statistics import bootstrap


def votes(outcomes: DataFrame, rev: str = "rev_idx", passed: str = "passed") -> DataFrame:
    """rev, status: good if all pass, bad if all fail, inconclusive if mixed or any is unresolved (null)."""
    p = F.col(passed)
    out = outcomes.groupBy(rev).agg(F.count(F.lit(1)).alias("runs"), F.count_if(p).alias("passes"), F.count_if(~p).alias("fails"))
    status = F.when(F.col("passes") == F.col("runs"), "good").when(F.col("fails") == F.col("runs"), "bad").otherwise("inconclusive")
    return out.withColumn("status", status)


def majority(outcomes: DataFrame, rev: str = "rev_idx", passed: str = "passed") -> DataFrame:
    """As votes, by majority; a tie is inconclusive."""
    out = votes(outcomes, rev, passed).drop("status")
    return out.withColumn("status", F.when(F.col("passes") > F.col("fails"), "good").when(F.col("fails") > F.col("passes"), "bad").otherwise("inconclusive"))


def classify(scores: DataFrame, reference: DataFrame, rev: str = "rev_idx", seed_col: str = "seed", higher: bool = True, tolerance: float = 0.0, resamples: int = 500, seed: int = 0, confidence: float = 0.95, min_observations: int = 5) -> DataFrame:
    """rev, n, estimate, lower, upper, status of every revision against the reference scores, paired by seed."""
    base = reference.select(seed_col, F.col("score").alias("base"))
    pairs = scores.join(base, seed_col).withColumn("difference", F.col("score") - F.col("base"))
    stats = bootstrap(pairs, [rev], [seed_col], "difference", resamples, seed, confidence)
    verdict = ternary(F.col("lower"), F.col("upper"), F.col("n"), F.lit(higher), F.lit(tolerance), min_observations)
    return stats.withColumn("status", F.when(verdict == "regression", "bad").when(verdict == "no_regression", "good").otherwise("inconclusive"))


def monotonicity(statuses: DataFrame, rev: str = "rev_idx") -> DataFrame:
    """One row: first_bad (null if the order isn't monotonic or an earlier one is inconclusive), first_seen_bad,
    good_after_bad, inconclusive_before, last_good. Two aggregations; no ordered scan in one task."""
    first = statuses.agg(F.min(F.when(F.col("status") == "bad", F.col(rev))).alias("first_seen_bad"))
    seen = statuses.join(F.broadcast(first), F.lit(True))
    out = seen.agg(
        F.first("first_seen_bad").alias("first_seen_bad"),
        F.count_if((F.col("status") == "good") & (F.col(rev) > F.col("first_seen_bad"))).alias("good_after_bad"),
        F.count_if((F.col("status") == "inconclusive") & (F.col(rev) < F.col("first_seen_bad"))).alias("inconclusive_before"),
        F.max(F.when((F.col("status") == "good") & (F.col(rev) < F.col("first_seen_bad")), F.col(rev))).alias("last_good"),
    )
    sure = (F.col("good_after_bad") == 0) & (F.col("inconclusive_before") == 0)
    return out.select(F.when(sure, F.col("first_seen_bad")).alias("first_bad"), "first_seen_bad", "good_after_bad", "inconclusive_before", "last_good")


def candidates(statuses: DataFrame, rev: str = "rev_idx") -> DataFrame:
    """Revisions that a non-monotonic order leaves open: the bad ones from the first bad one on."""
    first = statuses.agg(F.min(F.when(F.col("status") == "bad", F.col(rev))).alias("first_seen_bad"))
    return statuses.join(F.broadcast(first), F.lit(True)).where((F.col(rev) >= F.col("first_seen_bad")) & (F.col("status") != "good")).select(rev, "status")


def uncomputed(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of a cache that still have to be run."""
    return wanted.join(cache.select(*keys), keys, "left_anti")


class Cache:
    """Judgements kept on the shared file system: statuses of revisions under the identity of what was run."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.schema = "identity string, revision long, status string, seq long"

    def known(self, identity: str) -> dict[int, str]:
        """The latest status of each revision; one search's revisions, so few."""
        from ..sources.files import Files

        if not Files(self.spark, self.path).exists(""):
            return {}
        rows = self.spark.read.schema(self.schema).json(self.path).where(F.col("identity") == identity)
        return {r.revision: r.status for r in rows.groupBy("revision").agg(F.max_by("status", "seq").alias("status")).collect()}

    def keep(self, identity: str, statuses: Mapping[int, str]) -> None:
        import time

        rows = [(identity, int(r), s, time.time_ns()) for r, s in statuses.items()]
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").json(self.path)


def search(revisions: Sequence[int], judge: Callable[[int], str], max_evaluations: int | None = None, known: Mapping[int, str] | None = None) -> dict[str, Any]:
    """The first bad of ordered revisions, by halving: judge gives good, bad or inconclusive and is asked once each.

    An inconclusive revision is passed over towards its neighbours. The result has first_bad, last_good, the statuses
    asked for or known, whether the budget ran out, and whether they contradict an order of good before bad; then, or
    if an inconclusive revision lies between the last good and the first bad one, first_bad is None.
    """
    statuses, asked = dict(known or {}), 0

    def status(i: int) -> str | None:
        nonlocal asked
        if revisions[i] not in statuses:
            if max_evaluations is not None and asked >= max_evaluations:
                return None
            asked += 1
            statuses[revisions[i]] = judge(revisions[i])
        return statuses[revisions[i]]

    low, high, spent = -1, len(revisions), False  # the last known good, the first known bad
    while high - low > 1 and not spent:
        middle = (low + high) // 2
        near = sorted(range(low + 1, high), key=lambda i: abs(i - middle))
        for i in near:
            found = status(i)
            if found is None:
                spent = True
            if found != "inconclusive":
                break
        else:
            break
        if found == "good":
            low = i
        elif found == "bad":
            high = i
    places = {r: i for i, r in enumerate(revisions)}
    bad = [places[r] for r, s in statuses.items() if s == "bad" and r in places]
    good = [places[r] for r, s in statuses.items() if s == "good" and r in places]
    contradicted = bool(bad) and any(i > min(bad) for i in good)
    sure = high < len(revisions) and high - low == 1 and not contradicted
    return {"first_bad": revisions[high] if sure else None, "last_good": revisions[low] if low >= 0 else None, "statuses": statuses, "evaluations": asked, "spent": spent, "contradicted": contradicted}
