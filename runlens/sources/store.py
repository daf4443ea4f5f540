"""A content-addressed store as a table, on any file system that Spark reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .capsules import put_content, verify_content
from .files import Files, without_credentials

SCHEMA = "sha256 string, size long, media_type string, content binary, prefix string"


class ContentStore:
    """Contents by their SHA-256, partitioned by its first two digits.

    Writing is by Spark's commit protocol, so a lost executor leaves nothing behind; a content that is there already
    isn't written again, and one that two writers brought at once is read once.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, f"{without_credentials(root)}/sha256"

    def _table(self) -> DataFrame:
        files = Files(self.spark, self.root)
        return self.spark.read.schema(SCHEMA).parquet(self.root) if files.exists("") else self.spark.createDataFrame([], SCHEMA)

    def put(self, df: DataFrame, content: str = "content", media_type: str | None = None) -> DataFrame:
        """Write what is new; returns sha256, size, key of every different content of df."""
        named = F.col(media_type) if media_type else F.lit(None)
        rows = put_content(df.select(F.col(content).cast("binary").alias("content"), named.cast("string").alias("media_type")).withColumn("size", F.octet_length("content")), keep=["size", "media_type"])
        rows = rows.withColumn("prefix", F.substring("sha256", 1, 2))
        fresh = rows.join(self._table().select("prefix", "sha256"), ["prefix", "sha256"], "left_anti")
        fresh.select("sha256", F.col("size").cast("long").alias("size"), "media_type", "content", "prefix").write.mode("append").partitionBy("prefix").parquet(self.root)
        return rows.select("sha256", "size", "key")

    def get(self, digests: DataFrame) -> DataFrame:
        """sha256, media_type, content, intact of the digests that are there; intact tells whether the content still
        has its digest."""
        wanted = digests.select("sha256").distinct().withColumn("prefix", F.substring("sha256", 1, 2))
        found = self._table().join(wanted, ["prefix", "sha256"], "left_semi").dropDuplicates(["sha256"])
        return verify_content(found).select("sha256", "media_type", "content", "intact")

    def get_bytes(self, digest: str) -> bytes:
        """One content; a missing or damaged one is an error."""
        row = self.get(self.spark.createDataFrame([(digest,)], "sha256 string")).first()
        if row is None:
            raise FileNotFoundError(digest)
        if not row.intact:
            raise ValueError(f"the content of {digest} has changed")
        return bytes(row.content)
