import hashlib
import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from runlens.functions import words
from runlens.operators import draws, statistics
from runlens.plans import experiments

from .test_twins import SF


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_first_words_are_those_of_md5():
    for start in (0, 95, 99_990):
        for prefix in (b"1:0:", b"7:13:", b"7:199:", b"x" * 53):
            got = [int(w) for t in words.digits(start, start + 40) for w in next(words.first_words([prefix], t))]
            assert got == [int(hashlib.md5(prefix + str(i).encode()).hexdigest()[:8], 16) for i in range(start, start + 40)]


def samples(spark):
    return spark.range(6000).selectExpr("CASE WHEN id % 9 < 8 THEN 'a' ELSE 'b' END AS g", "nullif(id % 3, 0) AS h", "id", "CASE WHEN id % 7 = 0 THEN NULL ELSE cast(id * 7919 % 1013 AS double) / 10 END AS value")


def test_draws_are_never_broadcast(spark):
    """Fifty rows look small and have 25,000,000 draws."""
    rows = statistics.indexed(spark.createDataFrame([(1, i, float(i)) for i in range(50)], "g int, id long, value double"), ["g"], ["id"], "value")
    assert "Broadcast" not in plan(statistics.resampled(rows, ["g"], 500_000, 1))


@pytest.mark.parametrize("kind", draws.KINDS)
def test_draws_in_workers_are_those_of_the_join(spark, kind):
    df = samples(spark)
    joined = statistics.resampled(statistics.indexed(df, ["g"], ["id"], "value"), ["g"], 5, 3).groupBy("g", "r").agg(statistics.AGGREGATES[kind]("value").alias("s"))
    key = lambda rows: {(r.g, r.r): r.s for r in rows.collect()}
    assert key(draws.drawn_statistics(df, ["g"], ["id"], "value", 5, 3, kind)) == pytest.approx(key(joined))


@pytest.mark.parametrize("key", ["nullif(id % 2000, 7)", "if(id % 2 = 0, -1, 1) * double(id % 4)"])
def test_small_groups_among_large_ones_are_drawn_by_one_share(spark, monkeypatch, key):
    df = spark.range(9000).selectExpr(f"CASE WHEN id % 3 < 2 THEN {key} ELSE 5 END AS g", "id", "CASE WHEN id % 7 = 0 THEN NULL ELSE cast(id * 7919 % 1013 AS double) / 10 END AS value").where("g IS NOT NULL OR id % 2 = 0")
    drawn_from, map_in_arrow = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **k: (drawn_from.append(self), map_in_arrow(self, *a, **k))[1])
    for kind in ("p95", "sum"):
        joined = statistics.resampled(statistics.indexed(df.where("g IS NOT NULL"), ["g"], ["id"], "value"), ["g"], 30, 3).groupBy("g", "r").agg(statistics.AGGREGATES[kind]("value").alias("s"))
        found = lambda rows: {(r.g, r.r): r.s for r in rows.where("g IS NOT NULL").collect()}
        assert found(draws.drawn_statistics(df, ["g"], ["id"], "value", 30, 3, kind)) == pytest.approx(found(joined))
    if "double" not in key:
        assert drawn_from[1].count() < 3 * df.select("g").distinct().count()


def test_large_groups_are_drawn_in_workers_and_not_exploded(spark, monkeypatch):
    monkeypatch.setattr(statistics, "resampled", None)
    for query in (experiments.independent_bootstrap, experiments.paired_bootstrap):
        monkeypatch.setattr(statistics, "SMALL_DRAWS", 0)
        assert query(spark, SF).count() > 0


@pytest.mark.parametrize("small", [0, statistics.SMALL_DRAWS])
def test_statistics_of_resamples_are_never_broadcast(spark, monkeypatch, small):
    """Few rows look small and have groups * resamples statistics on each side."""
    monkeypatch.setattr(statistics, "SMALL_DRAWS", small)
    rows = spark.range(600).selectExpr("id", "id % 150 AS g", "cast(id AS double) AS value")
    for kind in ("p95", "mean"):
        out = statistics.independent_bootstrap(rows, rows, ["g"], ["id"], "value", 20, 1, aggregate=kind)
        joins = re.findall(r"(\w+Join) \[g#\d+L, r#\d+\]", plan(out))
        assert joins and set(joins) == {"SortMergeJoin"}


def test_poisson_sums_are_those_of_the_exploded_weights(spark):
    df = samples(spark)
    one = statistics.poisson_draw(df, ["id", "h"], 4, 5).groupBy("g", "h", "r").agg(F.sum(F.col("w") * F.col("value")).alias("s"), F.sum("w").alias("w"))
    key = lambda rows: {(r.g, r.h, r.r): (round(r.s, 6), r.w) for r in rows.collect()}
    assert key(one) == key(draws.poisson_sums(df, ["g", "h"], ["id", "h"], "value", 4, 5))
