import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions import decisions, values
from runlens.operators import comparison, gate, pairing, statistics

NAN = float("nan")


def obs(spark, rows):
    return spark.createDataFrame(rows, "name string, token string, value double")


def side(spark, name, vals, ids=None):
    return obs(spark, [(name, str(i) if ids is None else ids[i], v) for i, v in enumerate(vals)])


def test_paired_differences_skip_failures(spark):
    b = obs(spark, [("m", "a", 1.0), ("m", "b", None), ("m", "c", 3.0), ("m", "d", NAN)])
    c = obs(spark, [("m", "a", 2.0), ("m", "b", 4.0), ("m", "c", None), ("m", "d", 8.0)])
    pairs = pairing.paired_observations(b, c, ["name"])
    assert pairs.count() == 4
    assert [r.difference for r in pairing.paired_differences(pairs).collect()] == [1.0]


def test_repeated_identities_give_no_pairs_in_their_group_only(spark):
    b = obs(spark, [("m", "x", 1.0), ("m", "x", 2.0), ("k", "x", 1.0)])
    c = obs(spark, [("m", "x", 1.0), ("m", "x", 2.0), ("k", "x", 5.0)])
    assert [(r.name, r.candidate) for r in pairing.paired_observations(b, c, ["name"]).collect()] == [("k", 5.0)]
    assert pairing.paired_observations(b.drop("name"), c.drop("name")).count() == 0
    assert pairing.paired_observations(b.where("name = 'k'").drop("name"), c.where("name = 'k'").drop("name")).count() == 1


def test_states(spark):
    df = spark.createDataFrame([("1.5",), ("nan",), ("Infinity",), ("-Infinity",), (None,), ("x",), ("-0.0",)], "v string")
    assert [r.s for r in df.select(values.observation_state(F.col("v")).alias("s")).collect()] == ["finite", "nan", "pos_inf", "neg_inf", "missing", "failed", "finite"]


def test_identity_tokens_keep_types_apart(spark):
    df = spark.createDataFrame([(1, 1.0, "1", True)], "a long, b double, c string, d boolean")
    row = df.select(*[values.identity_token(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]).first()
    assert tuple(row) == ("1", "1.0", '"1"', "true")


def test_directions(spark):
    df = spark.createDataFrame([(n,) for n in ("val-loss", "sentiment", "accuracy", "inference_time", "parameter")], "n string")
    assert [r.h for r in df.select(values.metric_higher_is_better(F.col("n")).alias("h")).collect()] == [False, True, True, False, True]
    df = spark.createDataFrame([(n,) for n in ("latency_ms", "gpu_utilization", "samples_per_second")], "n string")
    assert [r.h for r in df.select(values.resource_higher_is_better(F.col("n")).alias("h")).collect()] == [False, True, True]


def test_regressions_of_five_seeds(spark):
    ids = ["11", "29", "37", "53", "71"]
    b = side(spark, "accuracy", [0.80, 0.81, 0.79, 0.80, 0.80], ids).unionByName(side(spark, "latency_ms", [10.0] * 5, ids))
    c = side(spark, "accuracy", [0.70, 0.71, 0.69, 0.70, 0.70], ids).unionByName(side(spark, "latency_ms", [15.0] * 5, ids))
    rows = comparison.compare(b, c, {"accuracy": 0.05, "latency_ms": 0.2}, resamples=200)
    assert {r.name: (r.regression, r.status) for r in rows.collect()} == {"accuracy": (True, "fail"), "latency_ms": (True, "fail")}
    assert comparison.overall(rows).first().status == "fail"


def test_order_does_not_matter(spark):
    b, c = side(spark, "m", [1.0, 2.0, 3.0, 9.0]), side(spark, "m", [2.0, 2.5, 3.5, 4.0])
    one = comparison.compare(b, c, resamples=100).collect()
    two = comparison.compare(b.repartition(3).orderBy(F.desc("token")), c.orderBy(F.desc("value")), resamples=100).collect()
    assert one == two


def test_missing_and_thin_evidence_is_never_a_pass(spark):
    one = comparison.compare(side(spark, "m", [1.0]), side(spark, "m", [1.0]), resamples=20).first()
    assert one.status == "inconclusive" and one.insufficient
    gone = comparison.compare(side(spark, "m", [1.0, 2.0]), obs(spark, []), resamples=20).first()
    assert gone.status == "inconclusive" and gone.candidate_missing
    twice = comparison.compare(side(spark, "m", [1.0, 2.0], ["7", "7"]), side(spark, "m", [1.0, 2.0], ["7", "7"]), resamples=20).first()
    assert twice.status == "inconclusive" and twice.shared_observations == 0
    assert comparison.overall(comparison.compare(obs(spark, []), obs(spark, []), resamples=5)).first().status == "inconclusive"


def test_noninferiority_gate(spark):
    rows = comparison.compare(side(spark, "accuracy", [0.9] * 3), side(spark, "accuracy", [0.88] * 3), {"accuracy": 0.1}, {"accuracy": 0.01}, resamples=50)
    r = rows.first()
    assert not r.regression and not r.noninferior and r.status == "fail"
    assert gate.result(gate.checks(rows, required=["accuracy"])).first().passed
    assert gate.result(gate.checks(rows, required=["absent"])).first().failed == ["required_evidence"]


def test_gate_on_nonfinite_health_and_parity(spark):
    rows = comparison.compare(side(spark, "accuracy", [1.0, 2.0, 3.0]), side(spark, "accuracy", [1.0, 2.0, NAN]), resamples=50)
    runs = spark.createDataFrame([("candidate", "new-4", "failed"), ("candidate", "new-1", "completed"), ("baseline", "old", "completed")], "side string, run_id string, status string")
    health = comparison.run_health(runs)
    assert {r.side: (r.any_failed, r.failed_runs) for r in health.collect()} == {"candidate": (True, ["new-4"]), "baseline": (False, [])}
    parity = comparison.group_parity(spark.createDataFrame([("g", True), ("g", None)], "g string, parity boolean"), ["g"])
    assert parity.first().parity is None
    checks = gate.checks(rows, health, parity)
    assert set(gate.result(checks).first().failed) == {"no_non_finite_candidate_observations", "run_completed_successfully", "parity"}
    assert gate.result(checks).first().exit_code == 1
    lenient = gate.checks(rows, health, parity, fail_on_nonfinite=False, fail_on_failed_run=False, fail_on_parity_failure=False)
    out = gate.result(lenient).first()
    assert out.passed and len(out.warnings) == 3
    assert gate.result(checks.limit(0)).first().exit_code == 1
    for kind, part in (("text", "FAIL"), ("json", '"passed": false'), ("junit", 'failures="3"'), ("sarif", '"version": "2.1.0"'), ("github", "::error title=parity::")):
        assert part in gate.report(checks, kind)


def test_bootstrap_matches_brute_force(spark):
    import hashlib

    vals = [3.0, 1.0, 4.0, 1.0, 5.0]
    got = statistics.bootstrap(side(spark, "m", vals), ["name"], ["token"], "value", 64, 9).first()
    draw = lambda r, i: int(hashlib.md5(f"9:{r}:{i}".encode()).hexdigest()[:8], 16) % 5
    means = sorted(sum(vals[draw(r, i)] for i in range(5)) / 5 for r in range(64))
    at = 0.025 * 63
    assert got.lower == pytest.approx(means[int(at)] + (at % 1) * (means[int(at) + 1] - means[int(at)]))
    assert got.estimate == pytest.approx(2.8) and got.n == 5


def test_exact_engine_uses_the_generator(spark):
    import random

    vals, rng = [1.0, 2.0, 4.0], random.Random(5)
    means = sorted(sum(vals[rng.randrange(3)] for _ in range(3)) / 3 for _ in range(40))
    got = statistics.exact_bootstrap(side(spark, "m", vals), ["name"], ["token"], "value", 40, 5).first()
    at = 0.975 * 39
    assert got.upper == pytest.approx(means[int(at)] + (at % 1) * (means[min(39, int(at) + 1)] - means[int(at)]))


def test_effect_size_without_spread(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 0.0), ("c", 1.0), ("d", 1.0), ("d", 3.0)], "name string, difference double")
    got = {r.name: r.effect_size for r in statistics.effect_size(df, ["name"]).collect()}
    assert got["a"] == math.inf and got["b"] == 0.0 and got["c"] is None and got["d"] == pytest.approx(2 / math.sqrt(2))


def test_designs_and_last_values(spark):
    b = spark.createDataFrame([("s", "1"), ("s", "2"), ("i", None), ("a", "1"), ("a", "1"), ("x", None)], "name string, token string")
    c = spark.createDataFrame([("s", "1"), ("i", None), ("a", "1"), ("x", "1")], "name string, token string")
    assert {r.name: r.pairing for r in pairing.sample_design(b, c, ["name"]).collect()} == {"s": "stable_identity", "i": "independent", "a": "ambiguous", "x": "incompatible"}
    df = spark.createDataFrame([("r", 1, 1.0), ("r", 2, 2.0), ("r", 3, NAN), ("q", 1, NAN)], "run string, pos int, value double")
    got = {r.run: (r.outcome, r.nonfinite_within) for r in pairing.last_finite(df, ["run"], ["pos"]).collect()}
    assert got["r"] == (2.0, 1) and math.isnan(got["q"][0])


def test_ternary_and_relative_delta(spark):
    df = spark.createDataFrame([(-3.0, -2.0, 9), (-0.5, 1.0, 9), (-3.0, 1.0, 9), (-3.0, -2.0, 4), (NAN, 1.0, 9)], "lo double, hi double, n int")
    got = df.select(decisions.ternary(F.col("lo"), F.col("hi"), F.col("n"), F.lit(True), F.lit(1.0)).alias("d")).collect()
    assert [r.d for r in got] == ["regression", "no_regression", "inconclusive", "inconclusive", "inconclusive"]
    df = spark.createDataFrame([(2.0, 3.0), (-2.0, -3.0), (0.0, 0.0), (0.0, 1.0), (0.0, -1.0)], "b double, c double")
    assert [r.d for r in df.select(values.relative_delta(F.col("b"), F.col("c")).alias("d")).collect()] == [0.5, -0.5, None, math.inf, -math.inf]
    assert values.type_family(T.LongType()) == "integer" and values.type_family("interval day") != "integer"
