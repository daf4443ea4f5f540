"""Exact deduplication by a 128-bit content hash, native DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, drop_rows, ids_and_texts

#: Duplicate-group hashes that may be broadcast (16 bytes each); more of them are joined by a shuffle.
MAX_BROADCAST_GROUPS = 500_000


def _decided(df: DataFrame, id_col: str, text_col: str, keep: str, max_broadcast_groups: int) -> tuple[DataFrame, DataFrame]:
    """(all rows as doc_id, text; member_id, member_sign, text_sha256, keep_id, group_size of those in groups)."""
    scratch = Scratch(df.sparkSession, "exact")
    best = {"min": F.min, "max": F.max}[keep]
    rows = ids_and_texts(df, id_col, text_col)
    hashed = rows.withColumn("hash", F.unhex(F.md5("text")))
    several = scratch.write(hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "several")
    few = several.count() <= max_broadcast_groups
    members = scratch.write(hashed.join(F.broadcast(several) if few else several, "hash", "left_semi").select("hash", "doc_id", "text"), "members")
    # written, so that both sides of the join below are plain shuffles, of which a very large group can be split
    same = scratch.write(members.groupBy("hash", "text").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "same")
    decided = members.join(same, ["hash", "text"]).select(F.col("doc_id").alias("member_id"), F.sha2("text", 256).alias("member_sha"), F.xxhash64("text").alias("member_sign"), "keep_id", "group_size")
    return rows, scratch.write(decided, "decided")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", max_broadcast_groups: int = MAX_BROADCAST_GROUPS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by the MD5 of their text; keep_id is the smallest (keep="min") or largest ("max") id of
    the group. Only texts whose hash occurs more than once are moved, and inside those the bytes decide, so two
    texts of one hash are never merged. A group of any size is pre-aggregated before each shuffle.

    Null text counts as empty. A null id is never a keep_id beside other ids; a group of null ids only has a
    null keep_id and its rows count as kept. Repeated rows of one id count in group_size and share `kept`.
    An empty table gives an empty result. Other columns are not read.
    """
    rows, decided = _decided(df, id_col, text_col, keep, max_broadcast_groups)
    every = rows.select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    joined = every.join(decided.drop("member_sign").distinct(), F.col("doc_id").eqNullSafe(F.col("member_id")) & (F.col("text_sha256") == F.col("member_sha")), "left")
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which no equal text has a smaller id, with the columns of docs.

    Rows that repeat an id are judged by their own text each. A row with a null id goes if its text has a row with
    an id; equal texts of null ids only all stay, as do repeated rows of the kept id. Null text and empty tables as
    in exact_groups.
    """
    decided = _decided(docs, id_col, text_col, "min", MAX_BROADCAST_GROUPS)[1]
    gone = decided.where(~F.col("member_id").eqNullSafe(F.col("keep_id"))).select(F.col("member_id").alias("doc_id"), F.col("member_sign").alias("sign"))
    return drop_rows(docs, id_col, text_col, Scratch(docs.sparkSession, "exact-gone").write(gone, "removed"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="max")


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
