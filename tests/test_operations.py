import pytest
from pyspark.sql import functions as F

from runlens.functions.redaction import normalise_message, redact_text, redact_value, scan
from runlens.operators import bisection, dependencies, inputs, lineage, minimise, operations, trace
from runlens.sources import capsules


def test_trace_window_ring_and_ancestry(spark):
    rows = [("r", 1, "source", [], False), ("r", 2, "middle", ["source"], False), ("r", 3, "bad", ["middle"], True), ("r", 4, "later", ["lost"], False)]
    e = spark.createDataFrame(rows, "run string, seq int, id string, parents array<string>, abnormal boolean")
    assert trace.first_abnormal(e, ["run"], "seq").first().first_abnormal == 3
    assert [r.id for r in trace.around(e, ["run"], ["seq"], radius=0).collect()] == ["bad"]
    kept = trace.ring(e, ["run"], ["seq"], 2)
    assert {(r.id, r.dropped) for r in kept.collect()} == {("bad", 2), ("later", 2)}
    links = e.select("run", F.col("id").alias("node"), F.explode_outer("parents").alias("parent"))
    start = e.where("abnormal").select("run", F.col("id").alias("node"))
    assert {(r.node, r.depth) for r in trace.ancestry(links, start, ["run"]).collect()} == {("bad", 0), ("middle", 1), ("source", 2)}
    assert {r.parent for r in trace.missing_parents(kept, "parents", "id", ["run"]).collect()} == {"middle", "lost"}


def test_graph_closure_is_cycle_safe(spark):
    edges = spark.createDataFrame([("model:m", "feature:f", "uses"), ("feature:f", "dataset:d", "uses"), ("dataset:d", "model:m", "loop"), ("x", "y", "uses")], "source string, target string, kind string")
    root = spark.createDataFrame([("dataset:d",)], "id string")
    assert {(r.id, r.distance) for r in dependencies.closure(edges, root).collect()} == {("dataset:d", 0), ("feature:f", 1), ("model:m", 2)}
    assert {r.id for r in dependencies.closure(edges, root, downstream=False, include_roots=False).collect()} == {"model:m", "feature:f"}
    nodes = spark.createDataFrame([("model:m", "model"), ("dataset:d", "dataset")], "id string, kind string")
    assert {r.kind: r.check for r in dependencies.recommendations(dependencies.closure(edges, root), nodes).collect()}["unknown"] == "smoke_and_regression_tests"


def test_changed_lines_choose_functions(spark):
    nodes = spark.createDataFrame([("f:same", "function", "a.py", 1, 3), ("f:changed", "function", "a.py", 4, 8), ("file:a", "file", "a.py", None, None), ("file:b", "file", "b.py", None, None)], "id string, kind string, path string, line_from int, line_to int")
    changes = spark.createDataFrame([("a.py", 5), ("b.py", 1)], "path string, line int")
    assert {r.id for r in dependencies.changed_nodes(changes, nodes).collect()} == {"f:changed", "file:b"}


DIFF = """diff --git a/m.py b/m.py
--- a/m.py
+++ b/m.py
@@ -1,3 +1,4 @@
 one
-two
+2
+2.5
 three
--- a/gone.py
+++ /dev/null
@@ -7,1 +0,0 @@
-bye"""


def test_diff_lines(spark):
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(DIFF.split("\n"))], "id string, place int, line string")
    got = {(r.path, r.side, r.line) for r in lineage.parse_diff(lines, ["id"]).collect()}
    assert got == {("m.py", "removed", 2), ("m.py", "added", 2), ("m.py", "added", 3), ("gone.py", "removed", 7)}


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("select * from raw, other o -- from commented\n join read_parquet('data/events.parquet') e on true", {("raw", "reads"), ("other", "reads"), ("data/events.parquet", "reads")}),
        ("with recursive c(a) as (select 1 from base), d as (select * from c) select * from d /* from no */", {("base", "reads")}),
        ("insert into s.t select * from (select * from u) x where a in (select b from v)", {("s.t", "writes"), ("u", "reads"), ("v", "reads")}),
        ("create table if not exists n as select 'from quoted' from \"Q T\"", {("n", "writes"), ("Q T", "reads")}),
        ("update k set a = 1 from w", {("k", "writes"), ("w", "reads")}),
        ("delete from z where x is distinct from y", {("z", "writes")}),
        ("", set()),
    ],
)
def test_sql_lineage(sql, want):
    assert {(n, r) for n, r, _ in lineage.sql_lineage(sql)} == want


def test_dynamic_names_and_events(spark):
    assert lineage.sql_lineage("select * from raw_${day}") and lineage.sql_lineage("select * from {{ ref }}")[0][2]
    lines = ['{"job":{"namespace":"n","name":"j"},"inputs":[{"namespace":"n","name":"a"}],"outputs":[{"namespace":"n","name":"b"}]}'] * 2 + ["broken"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert {tuple(r) for r in lineage.read_openlineage(df).collect()} == {("n/j", "n/a", "reads"), ("n/b", "n/j", "produced_by")}
    made = df.limit(1).select(lineage.openlineage_event(F.lit("j"), F.array(F.lit("a")), F.array(F.lit("b"))).alias("e")).first().e
    assert '"name":"j"' in made and '"runId"' in made


def test_bisection(spark):
    rows = [(i, s, i < 2) for i in range(5) for s in range(5)]
    v = bisection.votes(spark.createDataFrame(rows, "rev_idx int, seed int, passed boolean"))
    assert bisection.monotonicity(v).first().first_bad == 2
    rows = [(0, True), (1, False), (2, True), (3, False)]
    v = bisection.votes(spark.createDataFrame(rows, "rev_idx int, passed boolean"))
    r = bisection.monotonicity(v).first()
    assert r.first_bad is None and r.good_after_bad == 1
    assert {x.rev_idx for x in bisection.candidates(v).collect()} == {1, 3}
    tie = bisection.majority(spark.createDataFrame([(0, True), (0, False)], "rev_idx int, passed boolean"))
    assert tie.first().status == "inconclusive"


def test_retention_and_queue(spark):
    items = spark.createDataFrame([("g", "old", 100.0, 100.0), ("g", "new", 100.0, 995.0)], "g string, path string, size double, mtime double")
    assert [(r.path, r.reason) for r in operations.retention_plan(items, ["g"], 1000.0, 500.0, 100.0).collect()] == [("old", "age")]
    assert [(r.path, r.reason) for r in operations.retention_plan(items, ["g"], 1000.0, None, 100.0).collect()] == [("old", "budget")]
    assert operations.retention_plan(items, ["g"], 1000.0, 500.0, 0.0, keep_recent=2).count() == 0
    ops = spark.createDataFrame([("k", 1, True), ("k", 2, False), ("j", 3, False)], "key string, seq int, fails boolean")
    assert {r.seq: r.state for r in operations.flush_queue(ops, "key", ["seq"], "fails").collect()} == {1: "failed", 2: "blocked", 3: "applied"}


def test_redaction(spark):
    df = spark.createDataFrame([("Authorization: Bearer abc.def, x",), ("postgres://u:pw@h/db",), ('password = "hunter2"; ok',), (None,)], "t string")
    got = [r.t for r in df.select(redact_text(F.col("t")).alias("t")).collect()]
    assert "abc.def" not in got[0] and got[1] == "postgres://u:<redacted>@h/db" and "hunter2" not in got[2] and got[3] is None
    leaf = spark.createDataFrame([("db_password", "x"), ("name", "y")], "k string, v string")
    assert [r.v for r in leaf.select(redact_value(F.col("k"), F.col("v")).alias("v")).collect()] == ["<redacted>", "y"]
    assert {(r.kind, r.findings) for r in scan(df.withColumn("id", F.lit(1)), "id", "t").collect()} >= {("bearer-token", 1), ("uri-credential", 1), ("named-secret", 1)}
    df = spark.createDataFrame([("record 101 failed",), ("record  202 failed",)], "m string")
    assert {r.m for r in df.select(normalise_message(F.col("m")).alias("m")).collect()} == {"record <number> failed"}


def test_minimise(spark):
    assert minimise.ddmin(list(range(30)), lambda x: {3, 17} <= set(x)) == [3, 17]
    with pytest.raises(ValueError):
        minimise.ddmin([1], lambda x: False)
    df = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (2, 9, 0), (3, 0, 0)], "row_idx long, a int, b int")
    hit = lambda d: not d.where("a = 9").isEmpty()
    assert [(r.a, r.b) for r in minimise.shrink_rows(df, hit).collect()] == [(9, 0)]
    assert minimise.shrink_columns(df, lambda d: "a" in d.columns).columns == ["a"]
    assert minimise.shrink_tokens("a b c d", lambda t: "c" in t) == "c"
    assert minimise.shrink_sequence("abcd", {3: [0]}, lambda x: "d" in x) == ["a", "d"]
    assert minimise.shrink_structure({"a": [1, 2, {"k": 700}], "b": "xyz"}, lambda v: v.get("a") and any(isinstance(i, dict) and i.get("k", 0) > 5 for i in v["a"])) == {"a": [{"k": 10}]}
    assert minimise.shrink_graph(["a", "b", "c"], [("a", "b"), ("b", "c")], lambda n, e: ("a", "b") in e) == (["a", "b"], [("a", "b")])
    test = minimise.Evaluator(lambda x: True, max_evaluations=3)
    minimise.ddmin(list(range(100)), test)
    assert test.evaluations <= 3


def test_inputs_do_not_depend_on_partitions(spark):
    one = inputs.input_cases(spark, 4, include_non_finite=True, seed=3).orderBy("case_id").collect()
    two = inputs.input_cases(spark, 4, include_non_finite=True, seed=3).repartition(5).orderBy("case_id").collect()
    assert str(one) == str(two) and len({str(r["values"]) for r in one}) == len(one)
    assert {r.category for r in one} == {"representative", "edge", "adversarial"}


def test_capsules(spark, tmp_path):
    for i in range(3):
        capsules.write_capsule(str(tmp_path / f"run{i}.zip"), {"run_id": f"r{i}", "status": "completed"}, {"metrics.json": b"[1]"})
    first = (tmp_path / "run0.zip").read_bytes()
    capsules.write_capsule(str(tmp_path / "run0.zip"), {"status": "completed", "run_id": "r0"}, {"metrics.json": b"[1]"})
    assert (tmp_path / "run0.zip").read_bytes() == first
    (tmp_path / "bad.zip").write_bytes(first[:-30])
    capsules.register(spark)
    rows = spark.read.format("capsule").load(str(tmp_path))
    assert {r.run_id for r in capsules.run_index(rows).collect()} == {"r0", "r1", "r2"}
    assert rows.where("error IS NOT NULL").count() == 1
    aliases = spark.createDataFrame([("best", "r1")], "alias string, run_id string")
    assert capsules.resolve(capsules.run_index(rows), aliases, "best").first().run_id == "r1"
    assert not any(map(capsules.safe_member, ["/a", "a/../b", "a\\b", "", "c:/x"])) and capsules.safe_member("a/b.json")
    for text in ('{"a": 1, "a": 2}', '{"a": NaN}'):
        with pytest.raises(ValueError):
            capsules.strict_json(text)


def test_directory_fingerprint_moves_with_its_content(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name / "nested").mkdir(parents=True)
        (tmp_path / name / "z.txt").write_text("z")
        (tmp_path / name / "nested" / "a.txt").write_text("a")
    a, b = (capsules.directory_fingerprint(spark, str(tmp_path / n)).first() for n in ("one", "two"))
    assert a == b and a.files == 2
    (tmp_path / "two" / "z.txt").write_text("y")
    assert capsules.directory_fingerprint(spark, str(tmp_path / "two")).first().sha256 != a.sha256


def test_prefix_holds(spark):
    items = spark.createDataFrame([("a/b",), ("a/bc",), ("a",), ("d/e/f",)], "path string")
    holds = spark.createDataFrame([("a/b",), ("d",)], "path string")
    assert {r.path for r in dependencies.held_by_prefix(items, holds).collect()} == {"a/b", "d/e/f"}
