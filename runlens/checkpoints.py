"""Checkpoints in the folder that the cluster names, and what needs a table's rows in a global order."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where the setting is absent and all runs in one
    process, as in tests. On a cluster without the setting this is an error: a machine's folder isn't shared."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/runlens-checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read from there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def tasks(df: DataFrame) -> int:
    """As many tasks as keep all cores busy until the end."""
    return max(32, 3 * df.sparkSession.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores, for work that takes long for each row: a small file is one task however many rows it has."""
    return df.repartition(tasks(df))


def numbered(df: DataFrame, order: list[str], name: str = "row_idx") -> DataFrame:
    """df with row numbers from 0 in the given order, without a window over the whole table.

    Rows are range-partitioned, sorted and written with their places, the driver sees one count per partition, and each
    partition's rows are numbered behind those before it.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place_", F.monotonically_increasing_id())
    held = checkpointed(sorted_)
    part = F.shiftright("place_", 33)
    counts = sorted((r.range_, r.n) for r in held.groupBy(part.alias("range_")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for number, n in counts:
        starts.append((number, total))
        total += n
    offsets = held.sparkSession.createDataFrame(starts, "range_ long, offset_ long")  # as many rows as partitions
    place = F.col("place_").bitwiseAND(F.lit((1 << 33) - 1))
    return held.withColumn("range_", part).join(F.broadcast(offsets), "range_").withColumn(name, F.col("offset_") + place).drop("range_", "offset_", "place_")


def extended(known: DataFrame, frontier: DataFrame, round_: int, every: int = 50) -> DataFrame:
    """known with the frontier of this round; written anew now and then, so that long loops keep short plans."""
    both = known.unionByName(frontier)
    return checkpointed(both) if round_ % every == 0 else both
