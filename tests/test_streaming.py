from pyspark.sql import functions as F

from runlens.streaming import live


def run(spark, tmp_path, name, make, mode, parts):
    path = str(tmp_path / "in")
    for i, rows in enumerate(parts):
        rows.coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = make(source).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_ring_keeps_the_first_abnormal_event(spark, tmp_path):
    part = lambda a, b: spark.range(a, b).select(F.lit(1).alias("k"), F.col("id").alias("seq"), (F.col("id") == 2).alias("bad"))
    rows = run(spark, tmp_path, "ring_out", lambda s: live.ring(s, "k", "seq", "bad", 3), "update", [part(0, 5), part(5, 9)])
    last = max(rows, key=lambda r: r.seen)
    assert (last.seen, last.dropped, last.first_abnormal, last.newest) == (9, 6, 2, [6, 7, 8])


def test_queue_blocks_behind_a_failure(spark, tmp_path):
    rows = [(1, 1, False), (1, 2, True), (1, 3, False), (2, 4, False)]
    df = spark.createDataFrame(rows, "k long, seq long, fails boolean")
    got = run(spark, tmp_path, "queue_out", lambda s: live.queue(s, "k", "seq", "fails"), "append", [df])
    assert {r.seq: r.state for r in got} == {1: "applied", 2: "failed", 3: "blocked", 4: "applied"}


def test_windows_and_repeats(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", "a", 1.0, 1), ("2024-01-01 00:00:02", "a", float("nan"), 2), ("2024-01-01 02:00:00", "a", 1.0, 3)]
    df = spark.createDataFrame(rows, "t string, name string, value double, id int").withColumn("t", F.col("t").cast("timestamp"))
    got = run(spark, tmp_path, "window_out", lambda s: live.windowed_summary(s, "t", "1 hour", ["name"], "value"), "append", [df])
    assert [(r.n, r.mean, r.nonfinite) for r in got] == [(2, 1.0, 1)]
    assert live.without_repeats(df, "t", ["id"]).isStreaming is False
