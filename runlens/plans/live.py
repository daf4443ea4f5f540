"""The live forms over `events` as a stream of what there is; each result is written by batches and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import shared_folder
from ..streaming import live
from .operations import FINDINGS
from .registry import query


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    # a pattern, as a stream takes a plain path for a folder and a table may be one file
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def drained(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there, writing each batch to a folder of its own, and read them."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/runlens-live-{uuid.uuid4().hex}"
    schema = df.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")  # a repeated batch replaces itself

    running = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    running.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out").select(*schema.names)


def live_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


LATEST = "l AS (SELECT to_timestamp(floor(epoch_us(max(ts)) / 1000) / 1000)::TIMESTAMP - INTERVAL 10 MINUTE AS w FROM events)"


@query("live_windows", f"WITH {LATEST}, g AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, avg(value) AS mean, 0::BIGINT AS nonfinite FROM events GROUP BY 1, 2) SELECT window_start::TIMESTAMP AS window_start, event_type, n, mean, nonfinite FROM g, l WHERE window_start + INTERVAL 1 HOUR <= w")
def live_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed windows only: the last ones wait for the watermark."""
    return drained(live.windowed_summary(live_events(spark, sf_dir), "ts", "1 hour", ["event_type"], "value"), "append").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("live_sessions", f"""WITH {LATEST}, p AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events), s AS (SELECT *, sum(CASE WHEN b IS NULL OR ts >= b + INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM p),
g AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k) SELECT session_start::TIMESTAMP AS session_start, session_end::TIMESTAMP AS session_end, user_id, n FROM g, l WHERE session_end <= w""")
def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drained(live.sessions(live_events(spark, sf_dir), "ts", "1 hour", ["user_id"]), "append")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("live_without_repeats", "SELECT DISTINCT user_id, event_type FROM events")
def live_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(live.without_repeats(live_events(spark, sf_dir).select("ts", "user_id", "event_type"), "ts", ["user_id", "event_type"]).select("user_id", "event_type"), "append")


@query("live_findings", f"SELECT id AS doc_id, kind, findings FROM ({FINDINGS}) WHERE findings > 0")
def live_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.redaction import SECRET_PATTERNS

    counts = drained(live.findings(stream(spark, sf_dir, "documents"), "text", ["doc_id"]), "append")
    cells = [F.struct(F.lit(n).alias("kind"), F.col(n.replace("-", "_")).cast("long").alias("findings")) for n, _, _ in SECRET_PATTERNS]
    return counts.select("doc_id", F.inline(F.array(*cells))).where("findings > 0")


@query("live_ring", "WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) SELECT user_id AS key, count(*) AS seen, greatest(count(*) - 20, 0) AS dropped, min(event_id) FILTER (WHERE event_type = 'error') AS first_abnormal, list_sort(list(event_id) FILTER (WHERE k <= 20)) AS newest FROM r GROUP BY user_id")
def live_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each key's last update says."""
    e = stream(spark, sf_dir, "events").withColumn("abnormal", F.col("event_type") == "error")
    updates = drained(live.ring(e, "user_id", "event_id", "abnormal", 20), "update")
    last = F.max_by(F.struct(*[c for c in updates.columns if c != "key"]), "seen").alias("x")
    return updates.groupBy("key").agg(last).select("key", "x.*")


@query("live_queue", "WITH q AS (SELECT user_id, event_id, event_type = 'error' AND event_id % 4 = 0 AS f, max((event_type = 'error' AND event_id % 4 = 0)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) SELECT user_id AS key, event_id AS seq, CASE WHEN b = 1 THEN 'blocked' WHEN f THEN 'failed' ELSE 'applied' END AS state FROM q")
def live_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = stream(spark, sf_dir, "events").withColumn("fails", (F.col("event_type") == "error") & (F.col("event_id") % 4 == 0))
    return drained(live.queue(ops, "user_id", "event_id", "fails"), "append")
