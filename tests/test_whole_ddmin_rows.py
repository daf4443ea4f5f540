from runlens.operators import minimise
from runlens.plans import operations

from .test_twins import SF


def test_ddmin_rows_hands_over_the_whole_table(spark, monkeypatch):
    given = []
    shrink = minimise.shrink_rows
    monkeypatch.setattr(minimise, "shrink_rows", lambda df, predicate, **k: given.append(df.count()) or shrink(df, predicate, **k))
    rows = operations.ddmin_rows(spark, SF).collect()
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    last = li.where("l_quantity = 50 AND l_linenumber = 4 AND l_returnflag = 'R'").selectExpr("max(struct(l_orderkey, l_linenumber)) AS f").first().f
    assert given == [li.count()] and [tuple(r) for r in rows] == [tuple(last)]
