"""Resource and configuration differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import finite_or_null, relative_delta
from ..checkpoints import checkpointed
from .statistics import AGGREGATES


def summaries(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """n, mean, min, max and nearest-rank p95 per group over finite values, and the number left_out."""
    finite = df.select(*by, finite_or_null(F.col(value)).alias("finite_"))
    return finite.groupBy(*by).agg(F.count("finite_").alias("n"), *[AGGREGATES[a]("finite_").alias(a) for a in ("mean", "min", "max", "p95")], F.count_if(F.col("finite_").isNull()).alias("left_out"))


def resource_delta(baseline: DataFrame, candidate: DataFrame, by: list[str], value: str = "value", aggregate: str = "mean") -> DataFrame:
    """baseline, candidate, delta and relative_delta of a summary over finite values, with their numbers; one-sided
    groups have null deltas."""
    own = lambda df, n: df.select(*by, finite_or_null(F.col(value)).alias("finite_")).groupBy(*by).agg(AGGREGATES[aggregate]("finite_").alias(n), F.count("finite_").alias(f"{n}_n"))
    both = own(baseline, "baseline").join(own(candidate, "candidate"), by, "full_outer")
    return both.withColumns({"delta": F.col("candidate") - F.col("baseline"), "relative_delta": relative_delta(F.col("baseline"), F.col("candidate"))})


def threshold_decision(deltas: DataFrame, higher: Column, threshold: Column) -> DataFrame:
    """mode none (no threshold), invalid (no relative delta) or threshold, and whether the harm exceeds it."""
    relative = F.col("relative_delta")
    harm = F.when(higher, -relative).otherwise(relative)
    mode = F.when(threshold.isNull(), "none").when(relative.isNull() & (F.col("delta").isNull() | (F.col("delta") != 0)), "invalid").otherwise("threshold")
    return deltas.withColumns({"mode": mode, "regression": (mode == "threshold") & F.coalesce(harm > threshold, F.lit(False))})


def json_leaves(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """keys..., path, value of the top-level members of a JSON object column."""
    return df.select(*keys, F.explode(F.from_json(json, "map<string,string>")).alias("path", "value"))


def nested_leaves(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """keys..., path, value of all leaves of a JSON column: members joined by dots, list items by their index.

    Level by level inside the plan, as long as some value is an object or a list; empty ones are leaves.
    """
    v = F.parse_json(F.col(json))
    rows = df.select(*keys, F.lit("").alias("path"), v.alias("v")).where("v IS NOT NULL")
    leaves = None
    while True:
        kind = F.schema_of_variant(F.col("v"))
        rows = checkpointed(rows.withColumn("kind", F.when(kind.startswith("OBJECT<") & (kind != "OBJECT<>"), "object").when(kind.startswith("ARRAY<") & (kind != "ARRAY<VOID>"), "list")))
        done = rows.where("kind IS NULL").select(*keys, "path", F.coalesce(F.variant_get("v", "$", "string"), F.to_json("v")).alias("value"))
        leaves = done if leaves is None else leaves.unionByName(done)
        if rows.where("kind IS NOT NULL").isEmpty():
            return leaves
        step = lambda name: F.when(F.col("path") == "", name).otherwise(F.concat_ws(".", "path", name))
        members = rows.where("kind = 'object'").select(*keys, "path", F.explode(F.from_json(F.to_json("v"), "map<string,variant>")).alias("name", "child")).select(*keys, step(F.col("name")).alias("path"), F.col("child").alias("v"))
        items = rows.where("kind = 'list'").select(*keys, "path", F.posexplode(F.from_json(F.to_json("v"), "array<variant>")).alias("i", "child")).select(*keys, step(F.col("i").cast("string")).alias("path"), F.col("child").alias("v"))
        rows = members.unionByName(items)


def config_changes(baseline: DataFrame, candidate: DataFrame, by: list[str]) -> DataFrame:
    """Leaves (by..., path, value) that differ, were added or were removed."""
    b = baseline.select(*by, "path", F.col("value").alias("old"), F.lit(True).alias("b_"))
    c = candidate.select(*by, "path", F.col("value").alias("new"), F.lit(True).alias("c_"))
    joined = b.join(c, [*by, "path"], "full_outer")
    kind = F.when(F.col("b_").isNull(), "added").when(F.col("c_").isNull(), "removed").otherwise("changed")
    return joined.where(F.col("b_").isNull() | F.col("c_").isNull() | ~F.col("old").eqNullSafe(F.col("new"))).select(*by, "path", "old", "new", kind.alias("change"))
