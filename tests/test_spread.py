from pyspark.sql import functions as F

from runlens.operators import lineage, readers


def test_texts_of_one_small_file_are_read_by_many_tasks(spark):
    files = spark.range(200, numPartitions=1).select(F.concat(F.col("id").cast("string"), F.lit(".sh")).alias("path"), F.concat(F.lit("cat in/"), F.col("id").cast("string"), F.lit(".csv")).alias("text"))
    for out in (readers.read_sources(files), lineage.read_sql(files, "path", "text")):
        assert out.rdd.getNumPartitions() >= 32
    assert {(r.id, r.name) for r in readers.read_sources(files).collect()} == {(f"{i}.sh", f"in/{i}.csv") for i in range(200)}


def test_equal_texts_keep_their_own_files(spark, monkeypatch):
    monkeypatch.setattr(readers, "REMEMBERED", 2)
    texts = ["cat a.csv", "cat b.csv", "cat c.csv", "cat a.csv"] * 20
    shell = spark.createDataFrame([(f"{i}.sh", t) for i, t in enumerate(texts)], "path string, text string")
    assert sorted((r.id, r.name) for r in readers.read_sources(shell).collect()) == sorted((f"{i}.sh", t[4:]) for i, t in enumerate(texts))
    broken = spark.createDataFrame([(f"{i}.py", "def (") for i in range(40)], "path string, text string")
    assert {(r.id, r.name, r.relation) for r in readers.read_sources(broken).collect()} == {(f"{i}.py", f"{i}.py", "unreadable") for i in range(40)}
