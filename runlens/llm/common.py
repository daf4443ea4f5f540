"""What the corpus operators share: scratch tables in the cluster's shared folder, worker caches, inputs."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import shared_folder

#: Rows of one output batch of the Arrow operators.
BATCH_ROWS = 8192


def worker_cache(name: str, make: Any, large: bool = False) -> Any:
    """An object that lives as long as the Python worker and is shared by its tasks; of large ones only the last."""
    held = sys.__dict__.setdefault("_runlens_worker_cache", {})
    if name not in held:
        if large:
            free_large_caches()
        held[name] = (make(), large)
    return held[name][0]


def free_large_caches() -> None:
    """Let go of the worker's large object, and give freed memory back to the system: a worker lives through many
    stages, and what an earlier one needed would count against the next."""
    import ctypes
    import gc

    import pyarrow as pa

    held = sys.__dict__.get("_runlens_worker_cache", {})
    for name in [k for k, (_, big) in held.items() if big]:
        del held[name]
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: Lists that take down every scratch folder opened while they are here.
_WATCHED: list[list[Any]] = []


@contextmanager
def scratches() -> Iterator[list[Any]]:
    """The scratch folders that are opened inside, so that they can be removed when nothing reads them any more."""
    used: list[Any] = []
    _WATCHED.append(used)
    try:
        yield used
    finally:
        _WATCHED.remove(used)


class Scratch:
    """A folder of tables (and binary files) of one operator run, in the shared folder.

    Tables are written through Spark's commit protocol, so a lost executor costs only its own tasks, and
    what is read afterwards no longer depends on the lineage before it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        for used in _WATCHED:
            used.append(self)
        self.path = f"{shared_folder(spark).rstrip('/')}/runlens-{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, table: str, **options: str) -> DataFrame:
        path = f"{self.path}/{table}"
        df.write.options(**options).option("compression", options.get("compression", "zstd")).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: str) -> None:
        """Remove tables that nothing reads any more; all of them if none are named."""
        jvm = self.spark._jvm
        for place in [f"{self.path}/{t}" for t in tables] or [self.path]:
            path = jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in Arrow batches of at most 16 MB, unless the session asks for smaller ones."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "64m") in ("64m", "64MB", "67108864", "67108864b"):
        spark.conf.set(name, "16m")


def ids_and_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under names of its own; a null text is the empty one."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def filesystem(uri: str) -> tuple[Any, str]:
    """A pyarrow file system and the path in it, for local, HDFS and object-store addresses."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "", 1))


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether a table (better a written one) has at most max_rows rows."""
    return df.count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast a table whose counted rows stay within the bound; beyond it leave a shuffled join."""
    return F.broadcast(df) if small_enough(df, max_rows) else df


def batches(schema: Any, columns: list[list[Any]], rows: int = BATCH_ROWS) -> Iterator[Any]:
    """Cut long column lists into record batches."""
    import pyarrow as pa

    total = len(columns[0])
    for at in range(0, total, rows):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + rows], type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def unique_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have yet."""
    name, taken = stem, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sign_of(text: Column) -> Column:
    """The hash that tells texts of one id apart; a null text is the empty one."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def drop_rows(docs: DataFrame, id_col: str, text_col: str, removed: DataFrame, max_broadcast_rows: int = 2_000_000) -> DataFrame:
    """The rows of docs whose id and text are not among removed(doc_id, sign), with the columns of docs.

    Of rows that repeat an id only those with the removed text go; a null id is an id like any other.
    """
    own_id, own_sign = unique_name(docs, "removed_id"), unique_name(docs, "removed_sign")
    gone = removed.select(F.col("doc_id").alias(own_id), F.col("sign").alias(own_sign)).distinct()
    if small_enough(gone, max_broadcast_rows):
        gone = F.broadcast(gone)
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(F.col(own_id)) & (sign_of(docs[text_col]) == F.col(own_sign)), "left_anti")
