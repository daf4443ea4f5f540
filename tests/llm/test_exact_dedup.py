import hashlib
from collections import defaultdict

from runlens.llm.exact_dedup import drop_exact_duplicates, exact_groups

from .helpers import awkward, empty

TEXTS = ["a", "b", None, "", "a", "long " * 50_000, "b", "a ", "long " * 50_000, "A"]


def brute(texts, keep):
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    return {i: (keep(g), len(g), i == keep(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


def test_groups_match_brute_force(spark):
    for keep in ("min", "max"):
        for bound in (500_000, 0):  # broadcast and shuffled
            got = exact_groups(awkward(spark, TEXTS), keep=keep, max_broadcast_groups=bound).collect()
            assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == brute(TEXTS, min if keep == "min" else max)
            assert len(got) == len(TEXTS)


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "x"), (None, "y"), (1, "y"), (2, "z"), (2, "z")], "doc_id long, text string")
    got = exact_groups(df).collect()
    assert len(got) == 5
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(None, None, 1, True), (None, 1, 2, False), (1, 1, 2, True), (2, 2, 2, True)}


def test_empty_table(spark):
    assert exact_groups(empty(spark)).count() == 0
    assert drop_exact_duplicates(empty(spark)).count() == 0


def test_drop_keeps_columns_and_first(spark):
    docs = awkward(spark, TEXTS)
    out = drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 2, 5, 7, 9]


def test_no_python_in_the_plan(spark):
    plan = exact_groups(awkward(spark, TEXTS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_repeated_ids_are_judged_by_their_text(spark):
    df = spark.createDataFrame([(1, "B"), (5, "A"), (5, "B"), (None, "A"), (None, "C")], "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in drop_exact_duplicates(df).collect()), key=str)
    assert kept == sorted([(1, "B"), (5, "A"), (None, "C")], key=str)
