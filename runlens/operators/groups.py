"""Groups of recorded runs compared from their capsules: outcomes, pairing, health, parity, and the gate.

Both sides are rows of the capsule source: run_id, status, member, content.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from .comparison import compare
from .gate import ci_gate
from .pairing import last_finite
from .records import declared_identity, member, member_parity, pair_members, parity_evidence

METRICS = "array<struct<name:string,values:array<double>,steps:array<bigint>,value:double>>"


def runs_of(rows: DataFrame) -> DataFrame:
    """run_id, status, metadata, replay_plan, rng_state of readable capsules."""
    run = rows.where("error IS NULL AND member = 'run.json'").select("run_id", "status", F.col("content").cast("string").alias("run"))
    return run.select("run_id", "status", *[member("run", c).alias(c) for c in ("metadata", "replay_plan", "rng_state")])


def outcomes(rows: DataFrame) -> DataFrame:
    """run_id, name, value: of each run's metrics the last finite value (else the last value).

    Metrics stand in training/metrics.json, or among the run's own members where that is missing.
    """
    shown = rows.where("error IS NULL AND member = 'training/metrics.json'").select("run_id", F.col("content").cast("string").alias("json"))
    own = rows.where("error IS NULL AND member = 'run.json'").select("run_id", member(F.col("content").cast("string"), "metrics").alias("json"))
    texts = shown.unionByName(own.join(shown.select("run_id"), "run_id", "left_anti").where("json IS NOT NULL"))
    each = texts.select("run_id", F.inline(F.from_json("json", METRICS)))
    values = F.coalesce("values", F.when(F.col("value").isNotNull(), F.array("value")))
    points = each.where("name IS NOT NULL").select("run_id", "name", F.posexplode(values).alias("place", "value"))
    return last_finite(points, ["run_id", "name"], ["place"]).select("run_id", "name", F.col("outcome").alias("value"))


def artifacts_of(rows: DataFrame) -> DataFrame:
    """run_id, name, sha256, content of a capsule's members that may hold evidence."""
    return rows.where("error IS NULL AND member LIKE '%.json' AND content IS NOT NULL").select("run_id", F.col("member").alias("name"), "sha256", F.col("content").cast("string").alias("content"))


def sides(baseline: DataFrame, candidate: DataFrame) -> tuple[DataFrame, DataFrame]:
    """name, token, value of both sides: paired runs share a token, others have one of their own."""
    known = [checkpointed(declared_identity(runs_of(rows))) for rows in (baseline, candidate)]
    pairs = checkpointed(pair_members(*known))
    out = []
    for rows, column, tag in ((baseline, "baseline_run", "b:"), (candidate, "candidate_run", "c:")):
        token = pairs.select(F.col(column).alias("run_id"), F.concat(F.lit("p:"), "baseline_run").alias("pair_"))
        out.append(outcomes(rows).join(token, "run_id", "left").select("name", F.coalesce("pair_", F.concat(F.lit(tag), "run_id")).alias("token"), "value"))
    return out[0], out[1]


def compare_groups(baseline: DataFrame, candidate: DataFrame, **options: Any) -> DataFrame:
    """comparison.compare of two groups of capsules."""
    return compare(*sides(baseline, candidate), **options)


def gate_paths(spark: SparkSession, baseline: str, candidate: str, policy: Mapping[str, bool] | None = None, required: list[str] | None = None, **options: Any) -> tuple[int, DataFrame]:
    """(exit code, checks) of the capsules under two paths: comparison, health of the candidate's runs, and parity where
    any candidate has evidence of it. A capsule that can't be read is a failed run."""
    from ..sources.capsules import register

    register(spark)
    rows = [checkpointed(spark.read.format("capsule").load(p)) for p in (baseline, candidate)]
    broken = rows[1].where("error IS NOT NULL").select(F.lit("candidate").alias("side"), F.lit("failed").alias("status"), F.col("capsule").alias("run_id"))
    runs = runs_of(rows[1]).select(F.lit("candidate").alias("side"), "status", "run_id").unionByName(broken)
    parity = checkpointed(member_parity(runs_of(rows[1]), parity_evidence(runs_of(rows[1]), artifacts_of(rows[1]))))
    b, c = sides(*rows)
    return ci_gate(b, c, runs, None if parity.isEmpty() else parity, required, policy=policy, **options)
