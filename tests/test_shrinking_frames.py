import io
from contextlib import redirect_stdout

from runlens.checkpoints import numbered
from runlens.operators import minimise


def test_each_search_step_reads_what_the_last_one_left(spark, monkeypatch):
    written, write = [], minimise.checkpointed
    monkeypatch.setattr(minimise, "checkpointed", lambda df: written.append(df.count()) or write(df))
    monkeypatch.setattr(minimise, "SMALL_FRAME", 50)
    df = spark.range(1000).withColumnRenamed("id", "row_idx")
    out = minimise.shrink_rows(df, lambda d: d.where("row_idx IN (613, 989)").count() == 2)
    assert sorted(r.row_idx for r in out.collect()) == [613, 989]
    assert written[0] == 1000 and written[-1] <= 50 and all(b <= a // 2 for a, b in zip(written, written[1:], strict=False))


def test_numbers_are_places_of_the_sort_and_not_of_a_window(spark):
    out = io.StringIO()
    with redirect_stdout(out):
        numbered(spark.range(1000), ["id"]).explain()
    assert "Window" not in out.getvalue()
