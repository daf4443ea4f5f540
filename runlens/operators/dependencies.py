"""Dependency graphs: neighbours, closures with distance, changed lines, validation plans.

An edge points from the consumer (source) to what it depends on (target).
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed, extended

#: The validation that a kind of affected node asks for, and its priority.
CHECKS = {
    "dataset": ("data_quality_and_schema", "high"),
    "feature": ("feature_recompute_and_distribution", "high"),
    "model": ("model_regression_and_slices", "high"),
    "module": ("import_and_integration_smoke", "medium"),
    "file": ("import_and_integration_smoke", "medium"),
    "import": ("import_and_integration_smoke", "medium"),
    "function": ("focused_unit_tests", "medium"),
    "class": ("focused_unit_tests", "medium"),
}
OTHER_CHECK = ("smoke_and_regression_tests", "low")


def unite(nodes: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key; of each other column the last non-null value in arrival order."""
    rest = [c for c in nodes.columns if c not in (*key, order)]
    return nodes.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest])


def successors(edges: DataFrame, ids: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """node, neighbour: what the nodes depend on directly."""
    used = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    return used.join(ids.select(F.col("id").alias("source")).distinct(), "source", "left_semi").select(F.col("source").alias("node"), F.col("target").alias("neighbour")).distinct()


def predecessors(edges: DataFrame, ids: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """node, neighbour: what depends on the nodes directly."""
    used = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    return used.join(ids.select(F.col("id").alias("target")).distinct(), "target", "left_semi").select(F.col("target").alias("node"), F.col("source").alias("neighbour")).distinct()


def subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among the ids."""
    own = ids.select("id").distinct()
    return edges.join(own.withColumnRenamed("id", "source"), "source", "left_semi").join(own.withColumnRenamed("id", "target"), "target", "left_semi")


def closure(edges: DataFrame, roots: DataFrame, downstream: bool = True, include_roots: bool = True, max_depth: int | None = None) -> DataFrame:
    """id, distance of all transitive consumers (downstream) or dependencies of the roots; cycles are harmless.

    A frontier loop: each round is one join of the frontier with the edges and an anti join with what is known. Each
    frontier is checkpointed, so that plans stay short and a lost executor costs one round. The loop ends when nothing
    new is found; nodes that lie further than a given max_depth are an error, never left out.
    """
    start, end = ("target", "source") if downstream else ("source", "target")
    steps = checkpointed(edges.select(F.col(start).alias("id"), F.col(end).alias("next")).distinct())  # worked out once
    frontier = checkpointed(roots.select("id", F.lit(0).alias("distance")).distinct())
    known = frontier
    for distance in count(1):
        ahead = frontier.select("id").join(steps, "id").select(F.col("next").alias("id")).distinct()
        frontier = checkpointed(ahead.join(known, "id", "left_anti").withColumn("distance", F.lit(distance)))
        if frontier.isEmpty():
            break
        if max_depth is not None and distance > max_depth:
            raise ValueError(f"nodes lie further than max_depth={max_depth}")
        known = extended(known, frontier, distance)
    return known if include_roots else known.where("distance > 0")


def changed_nodes(changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, matched_by of nodes that a changed line lies in, else of the file or module nodes of that path.

    The join is by path; the line range is its condition.
    """
    lines = changes.select("path", "line").distinct()
    inner = nodes.where(F.col("kind").isin("function", "class"))
    hit = lines.join(inner, "path").where(F.col("line").between(F.col("line_from"), F.col("line_to")))
    found = hit.select("id", F.lit("range").alias("matched_by")).distinct()
    missed = lines.select("path").distinct().join(hit.select("path").distinct(), "path", "left_anti")
    whole = nodes.where(F.col("kind").isin("file", "module")).join(missed, "path", "left_semi")
    return found.unionByName(whole.select("id", F.lit("path").alias("matched_by")))


def check_of(kind: Column) -> tuple[Column, Column]:
    name, priority = F.lit(OTHER_CHECK[0]), F.lit(OTHER_CHECK[1])
    for k, (c, p) in CHECKS.items():
        name, priority = F.when(kind == k, c).otherwise(name), F.when(kind == k, p).otherwise(priority)
    return name, priority


def recommendations(affected: DataFrame, nodes: DataFrame) -> DataFrame:
    """kind, check, priority, affected (count), first_ids (the twenty smallest) per kind of affected node."""
    kinds = affected.join(nodes.select("id", "kind"), "id", "left").withColumn("kind", F.coalesce("kind", F.lit("unknown")))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("id"))
    out = kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("affected"))
    firsts = kinds.withColumn("rank_", rank).where("rank_ <= 20").groupBy("kind").agg(F.array_sort(F.collect_list("id")).alias("first_ids"))
    name, priority = check_of(F.col("kind"))
    return out.join(firsts, "kind").select("kind", name.alias("check"), priority.alias("priority"), "affected", "first_ids")


def skipped(nodes: DataFrame, affected: DataFrame, kind: str = "model") -> DataFrame:
    """Nodes of a kind that are not affected, whose validation can be left out."""
    return nodes.where(F.col("kind") == kind).join(affected.select("id"), "id", "left_anti").select("id")


def held_by_prefix(items: DataFrame, holds: DataFrame, path: str = "path") -> DataFrame:
    """Items whose path is a hold or lies under one: each path is cut into its prefixes and those are joined by
    equality, so that no theta join is needed."""
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    cut = items.select(path, F.explode(prefixes).alias("prefix_"))
    held = cut.join(holds.select(F.col(path).alias("prefix_")).distinct(), "prefix_", "left_semi").select(path).distinct()
    return items.join(held, path, "left_semi")


def lineage_events(edges: DataFrame, nodes: DataFrame, per_event: int = 10_000) -> DataFrame:
    """job, part, inputs, outputs: for each job node its sorted dependencies and its sorted consumers.

    A job with more than about per_event neighbours has several events, its neighbours dealt out by a hash, so that no
    row grows with the graph.
    """
    sides = edges.select(F.col("source").alias("job"), F.col("target").alias("other"), F.lit(True).alias("input")).unionByName(edges.select(F.col("target").alias("job"), F.col("source").alias("other"), F.lit(False).alias("input"))).distinct()
    jobs = nodes.where(F.col("kind") == "job").select(F.col("id").alias("job"))
    own = sides.join(jobs, "job", "left_semi")
    parts = own.groupBy("job").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(per_event))).cast("int").alias("parts"))
    dealt = own.join(parts, "job").withColumn("part", F.pmod(F.xxhash64("other"), F.col("parts")).cast("int"))
    names = lambda wanted: F.array_sort(F.collect_set(F.when(wanted, F.col("other"))))
    events = dealt.groupBy("job", "part").agg(names(F.col("input")).alias("inputs"), names(~F.col("input")).alias("outputs"))
    none = F.array().cast("array<string>")
    return jobs.join(events, "job", "left").select("job", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("inputs", none).alias("inputs"), F.coalesce("outputs", none).alias("outputs"))
