"""Roots of changes, plans, reports, configured relationships and pipeline files on small graphs."""

import json

from runlens.operators import impact

NODES = "id string, kind string, name string, path string, metadata string, line_from int, line_to int"


def graph(spark):
    nodes = [
        ("file:src/a.py", "file", "a", "src/a.py", None, None, None),
        ("module:src.a", "module", "src.a", None, None, None, None),
        ("module:src.a:f", "function", "f", "src/a.py", None, 3, 5),
        ("module:src.a:g", "function", "g", "src/a.py", None, 8, 9),
        ("feature:x", "feature", "x", None, None, None, None),
        ("model:m", "model", "m", None, None, None, None),
        ("dataset:d", "dataset", "d", "data/d.csv", None, None, None),
    ]
    edges = [("file:src/a.py", "module:src.a:f", "contains"), ("feature:x", "module:src.a:f", "calls"), ("model:m", "feature:x", "uses"), ("feature:x", "dataset:d", "reads")]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, impact.EDGES)


def changed(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, line int")


def test_roots_by_line_path_module_and_symbol(spark):
    nodes, edges = graph(spark)
    ids = lambda *rows: {(r.id, r.matched_by) for r in impact.roots(changed(spark, *rows), nodes, edges)[0].collect()}
    assert ("module:src.a:f", "range") in ids(("./src/a.py", 4)) and ("module:src.a:g", "range") not in ids(("src/a.py", 4))
    whole = {i for i, _ in ids(("src/a.py", None))}
    assert whole == {"file:src/a.py", "module:src.a", "module:src.a:f", "module:src.a:g"}
    assert ("file:src/a.py", "path") in ids(("a.py", 99))
    assert ids(("data/d.csv", None)) == {("dataset:d", "path")}
    assert ids(("conf/new.yaml", None)) == {("unknown:change:conf/new.yaml", "unknown:configuration")}


def test_unknown_changes_may_concern_anything(spark):
    nodes, edges = graph(spark)
    got = {r.id: r.distance for r in impact.plan(changed(spark, ("other.lock", None), ("more.bin", None)), nodes, edges).collect()}
    assert got["unknown:change:other.lock"] == got["unknown:change:more.bin"] == 0 and got["model:m"] == got["dataset:d"] == 1 and "module:src.a:f" not in got
    assert impact.plan(changed(spark), nodes, edges).count() == 0


def test_plan_and_report(spark):
    nodes, edges = graph(spark)
    got = {r.id: r.distance for r in impact.plan(changed(spark, ("src/a.py", 4)), nodes, edges).collect()}
    assert got["module:src.a:f"] == 0 and got["feature:x"] == 1 and got["model:m"] == 2
    mappings = {"models": {"m": ["feature:x"], "n": ["dataset:none"], "by_path": "src/"}, "datasets": {"e": {"depends_on": ["feature:x"]}}, "validations": {"py": ["*.py"], "sql": "*.sql"}}
    found = impact.report(changed(spark, ("src/a.py", 4)), nodes, edges, mappings)
    assert {(r.kind, r.name) for r in found["targets"].collect()} == {("model", "m"), ("model", "by_path"), ("dataset", "e")}
    assert {r.name for r in found["skipped"].collect()} == {"n"} and "py" in {r.name for r in found["validations"].collect()}
    assert {r.id for r in found["direct"].collect()} == {"feature:x", "file:src/a.py"} and found["affected"].first().distance == 0


def test_relationships(spark):
    config = {"datasets": {"d": {"path": "d.csv", "produces": ["f"]}}, "features": {"f": {"implemented_by": "module:a"}}, "models": [{"name": "m", "features": ["f"], "datasets": [{"name": "d"}]}, 3, {"no": "name"}], "relationships": [{"source": "m", "target": "d", "kind": "trained_on"}, {"target": "x"}]}
    nodes, edges = impact.relationships(spark, config)
    assert {r.id for r in nodes.collect()} == {"dataset:d", "feature:f", "model:m"}
    assert {(r.source, r.target, r.kind) for r in edges.collect()} == {("dataset:d", "file:d.csv", "implemented_by"), ("feature:f", "dataset:d", "configured"), ("feature:f", "module:a", "implemented_by"), ("model:m", "feature:f", "configured"), ("model:m", "dataset:d", "configured"), ("model:m", "dataset:d", "trained_on")}
    assert [df.count() for df in impact.relationships(spark, {})] == [0, 0]


def test_graphs_without_their_malformed_parts(spark):
    text = json.dumps({"nodes": [{"id": "a", "kind": "file"}, {"node_id": "b"}, {"kind": "x"}, 7], "edges": [{"source": "a", "target": "b", "relation": "reads"}, {"source": "a"}]})
    nodes, edges = impact.load_graph(spark.createDataFrame([(text,), ("not json",)], "value string"))
    assert {(r.id, r.kind) for r in nodes.collect()} == {("a", "file"), ("b", "unknown")} and [tuple(r) for r in edges.collect()] == [("a", "b", "reads")]


def test_stages_as_text(spark):
    nodes = spark.createDataFrame([("stage:t", "stage", "train", None, '{"cmd": "run it\'s"}'), ("pipeline:u", "other", "use", None, None), ("d", "dataset", None, "d.csv", None), ("o", "file", None, "o.bin", None), ("y", "dvc", None, "dvc.yaml", None)], impact.NODES)
    edges = spark.createDataFrame([("stage:t", "d", "k"), ("o", "stage:t", "k"), ("y", "stage:t", "k"), ("pipeline:u", "stage:t", "k"), ("stage:t", "d", "again")], impact.EDGES)
    stages = impact.dvc_stages(nodes, edges)
    assert impact.dvc_text(stages) == "stages:\n  train:\n    cmd: 'run it''s'\n    deps:\n      - 'd.csv'\n    outs:\n      - 'o.bin'\n  use:\n"
    assert json.loads(impact.dvc_text(stages, "json"))["stages"]["train"]["deps"] == ["d.csv"]
    assert impact.dvc_stages(nodes, edges, ["pipeline:u"]).count() == 1
