"""Trace events: first abnormal one, windows, rings, causal ancestry."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed, extended


def first_abnormal(events: DataFrame, by: list[str], seq: str, abnormal: str = "abnormal") -> DataFrame:
    """The first abnormal event's place per group; partial aggregation only."""
    return events.groupBy(*by).agg(F.min(F.when(F.col(abnormal), F.col(seq))).alias("first_abnormal"), F.count(F.lit(1)).alias("events"))


def around(events: DataFrame, by: list[str], order: list[str], abnormal: str = "abnormal", radius: int = 8) -> DataFrame:
    """Events within radius places of the first abnormal one, with their distance `offset` to it."""
    w = Window.partitionBy(*by)
    placed = events.withColumn("place_", F.row_number().over(w.orderBy(*order)))
    anchored = placed.withColumn("anchor_", F.min(F.when(F.col(abnormal), F.col("place_"))).over(w))
    return anchored.where(F.abs(F.col("place_") - F.col("anchor_")) <= radius).withColumn("offset", (F.col("place_") - F.col("anchor_")).cast("int")).drop("place_", "anchor_")


def ring(events: DataFrame, by: list[str], order: list[str], capacity: int = 2048) -> DataFrame:
    """The newest `capacity` events per group, with the number of dropped ones."""
    w = Window.partitionBy(*by)
    ranked = events.withColumns({"rank_": F.row_number().over(w.orderBy(*[F.desc(c) for c in order])), "dropped": F.greatest(F.count(F.lit(1)).over(w) - capacity, F.lit(0))})
    return ranked.where(F.col("rank_") <= capacity).drop("rank_")


def every_kth(events: DataFrame, by: list[str], step: str, k: int, keep: int) -> DataFrame:
    """Steps divisible by k, the newest `keep` of them per group."""
    w = Window.partitionBy(*by).orderBy(F.desc(step))
    return events.where(F.col(step) % k == 0).withColumn("rank_", F.row_number().over(w)).where(F.col("rank_") <= keep).drop("rank_")


def ancestry(links: DataFrame, starts: DataFrame, by: list[str], max_depth: int | None = None) -> DataFrame:
    """by..., node, depth of every ancestor (the start itself at depth 0); shortest path counts.

    links is by..., node, parent; starts is by..., node. Each round joins the frontier with the links and drops what
    is known, until nothing new is found; frontiers are checkpointed, so a cycle ends and plans stay short. A chain
    that is longer than a given max_depth is an error, never a shorter result.
    """
    links = checkpointed(links.where(F.col("parent").isNotNull()).select(*by, "node", "parent"))  # worked out once
    frontier = checkpointed(starts.select(*by, "node", F.lit(0).alias("depth")).distinct())
    known = frontier
    for depth in count(1):
        up = frontier.join(links, [*by, "node"]).select(*by, F.col("parent").alias("node")).distinct()
        frontier = checkpointed(up.join(known, [*by, "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        if max_depth is not None and depth > max_depth:
            raise ValueError(f"ancestors lie deeper than max_depth={max_depth}")
        known = extended(known, frontier, depth)
    return known


def missing_parents(events: DataFrame, parents: str, node: str, by: list[str]) -> DataFrame:
    """by..., parent of parents that no event has."""
    wanted = events.select(*by, F.explode(parents).alias("parent")).distinct()
    there = events.select(*by, F.col(node).alias("parent"))
    return wanted.join(there, [*by, "parent"], "left_anti")


def analyse(events: DataFrame, links: DataFrame, by: list[str], dropped_before: str, seq: str = "seq", radius: int = 8) -> DataFrame:
    """by..., node, part, detail: what a ring of events tells of its first abnormal event.

    events is by..., node, seq, abnormal, and dropped_before, the sequence number below which the ring has lost events;
    links is by..., node, parent, parent_seq. Parts are the ancestors (their depth), the roots (ancestors without a
    parent), parents that are missing (evicted if they lie before what the ring holds, else never_recorded), and the
    window around the event (the offset).
    """
    starts = events.where("abnormal").groupBy(*by).agg(F.min_by("node", seq).alias("node"))
    above = checkpointed(ancestry(links, starts, by))
    row = lambda df, part, detail: df.select(*by, F.col("node").cast("string").alias("node"), F.lit(part).alias("part"), detail.cast("string").alias("detail"))
    with_parent = links.where(F.col("parent").isNotNull()).select(*by, "node").distinct()
    roots = above.join(with_parent, [*by, "node"], "left_anti")
    wanted = above.select(*by, "node").join(links.where(F.col("parent").isNotNull()), [*by, "node"]).select(*by, F.col("parent").alias("node"), "parent_seq").distinct()
    lost = events.groupBy(*by).agg(F.max(dropped_before).alias("from_"))
    missing = wanted.join(events.select(*by, "node"), [*by, "node"], "left_anti").join(lost, by, "left")
    why = F.when(F.col("parent_seq") < F.col("from_"), "evicted").otherwise("never_recorded")
    window = around(events, by, [seq], radius=radius)
    return row(above, "ancestor", F.col("depth")).unionByName(row(roots, "root", F.lit(None))).unionByName(row(missing, "missing", why)).unionByName(row(window, "window", F.col("offset")))


def merge_traces(first: DataFrame, second: DataFrame, identity: list[str], order: str) -> DataFrame:
    """Both traces without repeats of the identity; the first source wins."""
    both = first.withColumn("source_", F.lit(0)).unionByName(second.withColumn("source_", F.lit(1)))
    w = Window.partitionBy(*identity).orderBy("source_", order)
    return both.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_", "source_")


def incident(tensors: DataFrame, events: DataFrame, by: list[str], order: str = "seq", radius: int = 8) -> DataFrame:
    """Tensor events and a run's own events as one trace around its first abnormal event, with their offset and source.

    Both have by..., kind, message, step, timestamp, tensor_id, the order and abnormal; an event that both tell is the
    tensor trace's, whose events come before others of the same order.
    """
    tagged = tensors.withColumn("source", F.lit("tensor")), events.withColumn("source", F.lit("run"))
    merged = merge_traces(*tagged, [*by, "kind", "message", "step", "timestamp", "tensor_id"], order)
    return around(merged.withColumn("late_", F.col("source") == "run"), by, [order, "late_"], radius=radius).drop("late_")


def tensor_stats(df: DataFrame, by: list[str], values: str) -> DataFrame:
    """min, max, mean, population deviation, finite share and norm of the elements of array columns; they are
    exploded into one aggregation that combines before its shuffle."""
    v = F.explode(values)
    x = F.col("x").cast("double")
    ok = ~F.isnan(x) & (F.abs(x) < float("inf"))
    finite = F.when(ok, x)
    return df.select(*by, v.alias("x")).groupBy(*by).agg(F.count(F.lit(1)).alias("elements"), F.min(finite).alias("min"), F.max(finite).alias("max"), F.avg(finite).alias("mean"), F.stddev_pop(finite).alias("std"), F.avg(ok.cast("double")).alias("finite_fraction"), F.sqrt(F.sum(finite * finite)).alias("norm"))


def non_finite(leaves: DataFrame, keys: list[str], value: str) -> DataFrame:
    x = F.col(value).cast("double")
    return leaves.where(F.isnan(x) | (F.abs(x) == float("inf"))).select(*keys, "path", F.when(F.isnan(x), "nan").when(x > 0, "pos_inf").otherwise("neg_inf").alias("state"))


def missing_steps(have: DataFrame, by: list[str], start: str, target: str, steps: DataFrame, step: str = "step") -> DataFrame:
    """Steps between start and target that are not there."""
    need = have.select(*by, F.explode(F.sequence(start, target)).alias(step))
    return need.join(steps.select(*by, step), [*by, step], "left_anti")
