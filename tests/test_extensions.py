"""Adapters, seeded runs, state trees, trackers, environment, readers, input specifications, search, the gate."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.operators import adapters, bisection, failures, gate, inputs, minimise, readers, records, state
from runlens.sources import capsules, environment, files, trackers


def test_three_ways_to_the_same_features(spark):
    df = spark.range(50).selectExpr("id AS row_idx", "cast(id AS double) AS x")
    sql = lambda d: adapters.sql_features(d, "SELECT row_idx, x * :f AS y FROM own_data", "own_data", {"f": 2.0})
    batch = lambda d: adapters.batch_features(d, lambda p: p.assign(y=p.x * 2)[["row_idx", "y"]], "row_idx bigint, y double")
    row = lambda d: adapters.row_features(d, lambda r: {"y": r["x"] * 2 + (r["x"] == 7)}, "y double", ["row_idx"])
    assert adapters.feature_parity(df, sql, batch).count() == 0
    assert [(r.row_idx, r.column) for r in adapters.feature_parity(df, sql, row).collect()] == [(7, "y")]
    df.createOrReplaceTempView("taken")
    with pytest.raises(ValueError):
        adapters.sql_features(df, "SELECT 1", "taken")
    spark.catalog.dropTempView("taken")


def test_seeded_runs_are_rows(spark):
    def runner(seed, scale):
        import random

        if seed == 3:
            raise KeyError("bad 3")
        return [seed * scale, random.random()]

    rows = {r.seed: r for r in adapters.run_seeds(spark, runner, [1, 2, 3], {"scale": 10}).collect()}
    again = {r.seed: r for r in adapters.run_seeds(spark, runner, [3, 2, 1], {"scale": 10}).collect()}
    assert rows == again and json.loads(rows[2].value)[0] == 20 and rows[3].error == "KeyError: 'bad 3'"
    found = failures.groups(adapters.failures_of(adapters.run_seeds(spark, runner, [3], {"scale": 1}))).first()
    assert (found.error_type, found.normalized_message) == ("KeyError", "'bad <number>'")
    with pytest.raises(TypeError):
        adapters.run_seeds(spark, runner, [True])


def test_state_trees_come_back_and_have_digests(spark):
    held = {}

    def put(data):
        import hashlib

        name = hashlib.sha256(data).hexdigest()
        held[name] = data
        return name

    value = {"a": (1, [2.5, None]), 3: {"@node": "list", "big": 2**70}, "w": np.arange(6, dtype="<f4").reshape(2, 3), "b": b"xy"}
    back = state.decode(json.loads(json.dumps(state.encode(value, put))), held.__getitem__)
    assert back["a"] == (1, [2.5, None]) and back[3] == {"@node": "list", "big": 2**70} and back["b"] == b"xy"
    assert back["w"].dtype == np.dtype("<f4") and (back["w"] == value["w"]).all()
    assert state.digest(value) == state.digest(back) and state.digest((1,)) != state.digest([1]) and state.digest({1: 2}) != state.digest({"1": 2})
    assert state.digest(float("nan")) is None and state.digest(object()) is None
    with pytest.raises(TypeError):
        state.encode(b"x")
    df = spark.createDataFrame([("1", '{"a": 1, "b": 2}'), ("2", '{"b": 2, "a": 1}'), ("3", "no"), ("4", None)], "id string, j string")
    got = {r.id: r.sha256 for r in state.digests(df, "id", "j").collect()}
    assert got["1"] == got["2"] and got["1"] and got["3"] is got["4"] is None


class Client:
    def __init__(self):
        self.log = []

    def get_run(self, run_id):
        return {"info": {"status": "FINISHED"}, "data": {"metrics": {"loss": 0.1, "acc": 0.9}}}

    def get_metric_history(self, run_id, name):
        return [{"step": s, "value": s / 10} for s in range(3)] if name == "loss" else []

    def start_run(self, run_id=None):
        import contextlib

        return contextlib.nullcontext({"info": {"run_id": run_id or "new"}})

    def log_param(self, *a):
        self.log.append(a)

    def log_metric(self, name, value, step):
        self.log.append((name, value, step))

    def log_artifact(self, path):
        self.log.append(path)


def test_trackers(spark):
    rows = trackers.import_runs(spark, Client, ["a", "b"]).collect()
    assert len(rows) == 8 and {(r.name, r.step, r.value) for r in rows if r.run_id == "a" and r.name == "acc"} == {("acc", 0, 0.9)} and {r.status for r in rows} == {"completed"}
    client = Client()
    metrics = spark.createDataFrame([("m", 1, 2.0), ("m", 0, 1.0)], "name string, step long, value double")
    assert trackers.export_run(client, {"metadata": {"k": [1]}}, metrics, "c.zip") == "new"
    assert client.log == [("k", "[1]"), ("m", 1.0, 0), ("m", 2.0, 1), "c.zip"]


def test_environment_hides_secrets(spark, tmp_path):
    env = {(r.section, r.name): r.value for r in environment.environment(spark, ["HOME", "API_TOKEN"], {"HOME": "/h", "API_TOKEN": "x", "OTHER": "y"}).collect()}
    assert env["variable", "HOME"] == "/h" and env["variable", "API_TOKEN"] == "<redacted>" and ("variable", "OTHER") not in env and any(s == "package" for s, _ in env)
    assert environment.system(spark).where("name = 'processors'").count() == 1
    assert environment.version_control(spark, str(tmp_path)).count() == 0
    place = files.Files(spark, str(tmp_path))
    environment.write_result(place, "r.json", {"a": 1})
    environment.write_result(place, "r.json", {"a": 2})
    assert environment.read_result(place, "r.json") == {"a": 2}
    with pytest.raises(ValueError):
        environment.write_result(place, "r.json", {"a": float("nan")})

    class Point:
        def __init__(self, name, value):
            self.name, self.value = name, value

        def load(self):
            return 1 / self.value

    assert environment.installed("g", [Point("z", 1), Point("b", 0), Point("a", 2)]) == [("a", 0.5), ("z", 1.0)]


def test_registered_readers_come_first(spark):
    df = spark.createDataFrame([("a.own", "x"), ("b.sql", "SELECT * FROM t"), ("bad.own", None)], "path string, text string")
    try:
        readers.register_reader("own", lambda p: p.endswith(".own"), lambda t: [(t, "reads", "static")])
        readers.register_reader("first", lambda p: p == "b.sql", lambda t: [("seen", "reads", "static")], priority=5)
        with pytest.raises(ValueError):
            readers.register_reader("own", lambda p: True, lambda t: [])
        assert readers.readers_in_order() == ["first", "own"]
        assert {(r.id, r.reader, r.name) for r in readers.read_sources(df).collect()} == {("a.own", "own", "x"), ("b.sql", "first", "seen")}
    finally:
        readers.REGISTERED.clear()


def test_input_specifications(spark):
    spec = inputs.InputSpec(("batch", 2, None), "int32", {"batch": [3]}, ("non_negative",))
    assert spec.resolve_shape(0) == (3, 2, 1)
    with pytest.raises(ValueError):
        inputs.InputSpec(("n",)).resolve_shape()
    rows = inputs.cases_of(spark, spec, include_non_finite=True).collect()
    assert rows and all(len(r["values"]) == 6 and min(r["values"]) >= 0 and r["shape"] == [3, 2, 1] for r in rows)
    hot = inputs.cases_of(spark, inputs.InputSpec((4,), constraints=("one-hot",))).first()
    assert hot["values"] == [1.0, 0.0, 0.0, 0.0]


def test_search_for_the_first_bad():
    judge = lambda r: "bad" if r >= 13 else "good"
    got = bisection.search(range(20), judge)
    assert (got["first_bad"], got["last_good"], got["contradicted"]) == (13, 12, False) and got["evaluations"] <= 6
    assert bisection.search(range(20), judge, max_evaluations=2)["spent"]
    assert bisection.search(range(20), lambda r: "good")["first_bad"] is None
    assert bisection.search(range(20), lambda r: "bad")["first_bad"] == 0
    assert bisection.search(range(20), lambda r: "inconclusive" if r == 12 else judge(r))["first_bad"] is None
    assert bisection.search(range(20), judge, known={2: "bad", 18: "good"})["contradicted"]
    assert bisection.search([], judge)["first_bad"] is None


def test_capsules_shrink_to_children(tmp_path):
    source, target, last = (str(tmp_path / n) for n in ("a.zip", "b.zip", "c.zip"))
    capsules.write_capsule(source, {"run_id": "r"}, {"replay/inputs.json": json.dumps(list(range(40))).encode(), "keep.txt": b"k"})
    record = minimise.shrink_capsule(source, target, lambda v: 17 in v, kind="rows")
    rows = {r[3]: r for r in capsules.read_capsule(target)}
    assert rows["replay/inputs.json"][6] == b"[17]" and rows["keep.txt"][6] == b"k" and rows["run.json"][1] == "r-shrunk-1" and record["verified"]
    minimise.shrink_capsule(target, last, lambda v: 17 in v, kind="rows")
    assert len(json.loads({r[3]: r for r in capsules.read_capsule(last)}["shrink.json"][6])["history"]) == 2
    with pytest.raises(ValueError):
        minimise.shrink_capsule(source, target, lambda v: True, member="none.json")


def test_the_gate_as_one_call(spark):
    base = spark.createDataFrame([("loss", i, 1.0) for i in range(20)], "name string, token long, value double")
    worse = base.withColumn("value", F.lit(3.0) + F.col("token") / 100)
    runs = spark.createDataFrame([("candidate", "completed", "r")], "side string, status string, run_id string")
    code, rows = gate.ci_gate(base, base, runs, resamples=50)
    assert code == 0 and rows.where("name LIKE 'run completed%'").count() == 1
    assert gate.ci_gate(base, worse, thresholds={"loss": 0.1}, resamples=50)[0] == 1
    own = spark.createDataFrame([("mine", "mine", "fail", "x")], "name string, check_id string, status string, details string")
    assert gate.ci_gate(base, base, extra=own, resamples=50)[0] == 1
    from runlens.operators.comparison import compare

    text = gate.render_comparison(compare(base, worse, thresholds={"loss": 0.1}, resamples=50))
    assert text.startswith("FAIL") and "20 pairs" in text


def test_thresholds_and_rendering(spark):
    assert records.parse_thresholds(["a=1", " b = 0.5"]) == {"a": 1.0, "b": 0.5}
    for bad in ("a", "=1", "a=x", "a=-1", "a=inf"):
        with pytest.raises(ValueError):
            records.parse_thresholds([bad])
    first, rest = records.rendered_top(spark.range(15), ["id"], 10)
    assert first[0] == {"id": 0} and rest == 5


def test_single_runs_pair_and_repeats_pair_in_order(spark):
    runs = lambda *r: spark.createDataFrame(list(r), "run_id string, identity string, pairable boolean")
    pairs = lambda b, c: sorted(tuple(r) for r in records.pair_members(b, c).collect())
    assert pairs(runs(("a", None, False)), runs(("b", None, False))) == [("a", "b")]
    assert pairs(runs(("a", "i", True), ("b", "i", True), ("c", None, False)), runs(("x", "i", True), ("y", "j", True))) == [("a", "x")]
    assert records.identities(records.declared_identity(spark.createDataFrame([("a", '{"trial": 1}'), ("b", "{}")], "run_id string, metadata string"))).count() == 1


def test_structured_texts_and_notebook_lines(spark):
    assert readers.load_structured('a = 1', "x.toml") == {"a": 1} and readers.load_structured('{"a": 1}\n{"a": 2}', "x.jsonl") == [{"a": 1}, {"a": 2}]
    assert readers.structured_or_reason("{", "x.json")[1].startswith("JSONDecodeError") and readers.structured_or_reason("a: 1")[0] == {"a": 1}
    cells = {"cells": [{"cell_type": "code", "source": "%sql SELECT * FROM t\n%run other.ipynb\nx = 1"}, {"cell_type": "code", "source": "%%time\nimport m"}]}
    assert {(n, r) for n, r, _ in readers.read_notebook(json.dumps(cells))} == {("t", "reads"), ("other.ipynb", "runs"), ("m", "imports")}


def test_nested_copies_without_secrets_and_within_bounds(spark):
    from runlens.operators import nested

    value = {"a": {"Api-Key": "x", "n": None}, "t": ["Bearer abc", 1], "password": None}
    assert nested.redact_tree(value) == {"a": {"Api-Key": "<redacted>", "n": None}, "t": ["Bearer <redacted>", 1], "password": None}
    df = spark.createDataFrame([("1", json.dumps(value)), ("2", "no")], "id string, j string")
    assert [json.loads(r.json) for r in nested.redact_json(df, "id", "j").collect()] == [nested.redact_tree(value)]
    assert nested.snapshot([1, 2, 3], 2) == ([1, 2], True) and nested.snapshot({"a": [[1]]}, max_depth=2) == ({"a": [None]}, True) and nested.snapshot([1, [2]], 2) == ([1, [2]], False)
    assert nested.snapshots(df, "id", "j", 1).first().truncated


def test_models_that_take_batches(spark):
    from runlens.operators import nested

    cases = spark.createDataFrame([(str(i), str(i)) for i in range(4)], "case_id string, input string").coalesce(1)
    rows, _ = nested.compare_batches(lambda v: [x * 2 for x in v], lambda v: [x * 2 + (x == 3) for x in v], cases)
    assert {r.case_id: r.status for r in rows.collect()} == {"0": "pass", "1": "pass", "2": "pass", "3": "fail"}
    assert {r.status for r in nested.compare_batches(lambda v: v, lambda v: v[:-1], cases)[0].collect()} == {"error"}


def test_files_and_archives_are_scanned(spark, tmp_path):
    import zipfile

    from runlens.functions.redaction import scan_files

    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_text("Authorization: Bearer abc")
    (tmp_path / "big.txt").write_text("x" * 5000)
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in.txt", 'password = "hunter2"')
    got = {(r.path.rsplit("/", 1)[1], r.member, r.kind) for r in scan_files(spark, str(tmp_path), 1000).collect()}
    assert {("a.txt", None, "bearer-token"), ("z.zip", "in.txt", "named-secret"), ("big.txt", None, "too_large")} <= got


def test_merged_capsules(tmp_path):
    from runlens.sources import index

    a, b, c = (str(tmp_path / n) for n in ("a.zip", "b.zip", "c.zip"))
    capsules.write_capsule(a, {"run_id": "a", "status": "failed", "x": 1}, {"m": b"1", "only": b"p"})
    capsules.write_capsule(b, {"run_id": "b", "status": "completed"}, {"m": b"2"})
    index.merge(a, b, c)
    rows = {r[3]: r for r in capsules.read_capsule(c)}
    assert rows["m"][6] == b"2" and rows["only"][6] == b"p" and rows["m"][1:3] == ("b", "completed") and json.loads(rows["run.json"][6])["parent_run_id"] == "a"


def test_evaluators_know_failures_and_steps(spark, tmp_path):
    test = minimise.Evaluator(lambda v: "E1" if 3 in v else "E2" if v else None, expected="E1")
    assert minimise.ddmin(list(range(6)), test) == [3]
    assert not minimise.Evaluator(lambda v: None)([1])
    small, used = minimise.shrink_input(list(range(200)), lambda v: 150 in v, max_steps=10)
    assert 150 in small and len(small) < 200 and used <= 10
    assert minimise.shrink_input("a b c", lambda t: "b" in t)[0] == "b" and minimise.shrink_input({"a": 1, "b": 9}, lambda v: v.get("b", 0) > 2)[0] == {"b": 4}
    cache = bisection.Cache(spark, str(tmp_path / "cache"))
    first = bisection.search(range(20), lambda r: "bad" if r >= 13 else "good", known=cache.known("me"))
    cache.keep("me", first["statuses"])
    again = bisection.search(range(20), lambda r: pytest.fail("asked again"), known=cache.known("me"))
    assert again["first_bad"] == 13 and again["evaluations"] == 0 and cache.known("other") == {}


def test_incidents_merge_tensor_and_run_events(spark):
    from runlens.operators import trace

    schema = "g int, kind string, message string, step int, timestamp double, tensor_id string, seq long, abnormal boolean"
    tensors = spark.createDataFrame([(1, "op", "nan", 3, 3.0, "t", 3, True), (1, "op", "ok", 2, 2.0, "t", 2, False)], schema)
    events = spark.createDataFrame([(1, "op", "nan", 3, 3.0, "t", 3, True), (1, "log", "x", 2, 2.0, None, 2, False), (1, "log", "y", 9, 9.0, None, 9, False)], schema)
    got = [(r.message, r.source, r.offset) for r in trace.incident(tensors, events, ["g"], radius=2).orderBy("offset").collect()]
    assert got == [("ok", "tensor", -2), ("x", "run", -1), ("nan", "tensor", 0), ("y", "run", 1)]


def test_statistics_and_names_of_the_callers(spark):
    from runlens.operators import pairing, statistics

    df = spark.createDataFrame([("a", i, float(i)) for i in range(30)], "name string, i long, value double")
    own = statistics.bootstrap(df, ["name"], ["i"], "value", 50, 1, aggregate=lambda c: F.max(c) - F.min(c)).first()
    assert own.estimate == 29.0 and own.lower <= 29.0
    assert {r.name for r in pairing.names_of(df, required=["z"]).collect()} == {"a", "z"}


def test_the_gate_from_paths(spark, tmp_path):
    from runlens.operators import groups

    def record(side, n, value, **more):
        metrics = capsules.structured_files({"metrics": [{"name": "accuracy", "values": [0.1, value]}]})
        capsules.write_capsule(str(tmp_path / side / f"{n}.zip"), {"run_id": f"{side}{n}", "status": "completed", "metadata": {"seed": n}, **more}, metrics)

    for side in ("base", "same", "worse", "sick"):
        (tmp_path / side).mkdir()
        for n in range(8):
            record(side, n, 0.9 + n / 1000 - (0.3 if side == "worse" else 0))
    gate_of = lambda side, **o: groups.gate_paths(spark, str(tmp_path / "base"), str(tmp_path / side), resamples=50, thresholds={"accuracy": 0.01}, **o)
    code, rows = gate_of("same")
    assert code == 0 and {r.status for r in rows.collect()} == {"pass"}
    assert gate_of("worse")[0] == 1 and gate_of("same", required=["loss"])[0] == 1
    (tmp_path / "sick" / "9.zip").write_bytes(b"broken")
    assert gate_of("sick")[0] == 1
    record("same", 3, 0.9, metadata={"seed": 3, "parity": {"passed": False}})
    assert gate_of("same")[0] == 1


def test_small_helpers(spark, tmp_path):
    from runlens.operators import behaviour, tables

    rows = spark.createDataFrame([(-0.05,), (0.2,)], "upper double")
    assert [r.regression for r in behaviour.behaviour_decision(rows, {"accuracy": 0.01}).orderBy("upper").collect()] == [True, False]
    leaf = lambda v: spark.createDataFrame([(1, "$", v, None)], "k int, path string, num double, str string")
    verdict = lambda profile: tables.output_parity(leaf(1.0), leaf(1.0005), ["k"], default=profile).first().reason
    assert verdict("fp16") is None and verdict("fp64") == "value"

    class Artifacts:
        def artifact(self, path, name):
            class Held:
                def download(self, folder):
                    return f"{folder}/{path}/{name}"

            return Held()

    assert trackers.import_capsule(Artifacts(), "team/run", "capsule.zip", str(tmp_path)).endswith("team/run/capsule.zip")
