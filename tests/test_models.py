import pytest
from pyspark.sql import functions as F

from runlens.operators import behaviour, resources, tables

NAN, INF = float("nan"), float("inf")
PRED = "row_idx long, baseline array<double>, candidate array<double>, label int"


def test_flips_and_accuracy(spark):
    rows = [(0, [0.9, 0.1], [0.8, 0.2], 0), (1, [0.2, 0.8], [0.3, 0.7], 1), (2, [0.6, 0.4], [0.4, 0.6], 0), (3, [0.7, 0.3], [0.6, 0.4], 0)]
    r = behaviour.change_counts(spark.createDataFrame(rows, PRED)).first()
    assert (r.class_flips, r.confidence_only, r.baseline_accuracy, r.candidate_accuracy, r.flips_to_incorrect) == (1, 3, 1.0, 0.75, 1)


def test_scalar_classes(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 0, 1), (1, 1, 1)], "baseline int, candidate int, label int")
    r = behaviour.change_counts(df).first()
    assert (r.class_flips, r.confidence_only, r.baseline_accuracy) == (1, 0, 1.0) and r.candidate_accuracy == pytest.approx(2 / 3)


def test_calibration_moves_while_classes_stay(spark):
    rows = [(i, [0.9, 0.1] if i % 2 else [0.1, 0.9], [0.6, 0.4] if i % 2 else [0.4, 0.6], 1 - i % 2) for i in range(10)]
    df = spark.createDataFrame(rows, PRED)
    assert behaviour.class_shift(behaviour.classes(df)).first().total_variation == 0
    b = behaviour.calibration_error(df, "baseline", "label").first().ece
    c = behaviour.calibration_error(df, "candidate", "label").first().ece
    assert c - b > 0.2 and b == pytest.approx(0.1)
    bad = df.unionByName(spark.createDataFrame([(99, [0.5, 0.9], [0.5, NAN], 0)], PRED))
    assert behaviour.calibration_error(bad, "baseline", "label").first().ece is None


def test_slices(spark):
    rows = [(region, x, True, region != "a") for region in "ab" for x in range(3)]
    df = spark.createDataFrame(rows, "region string, x int, b_correct boolean, c_correct boolean")
    got = {r.slice: (r.support, r.delta) for r in behaviour.categorical_slices(df, ["region"], min_support=3).collect()}
    assert got == {"region=a": (3, -1.0), "region=b": (3, 0.0)}
    assert behaviour.worst_slices(behaviour.categorical_slices(df, ["region"], 3), top=1).first().slice == "region=a"
    assert behaviour.pair_slices(df, ["region", "x"], min_support=1).count() == 6
    many = spark.range(100).select(F.col("id").cast("double").alias("v"), F.lit(True).alias("b_correct"), (F.col("id") < 75).alias("c_correct"))
    bins = behaviour.numeric_slices(many, "v").orderBy("lower").collect()
    assert len(bins) == 4 and sum(r.support for r in bins) == 100 and bins[-1].delta < -0.9 and bins[0].delta == 0


def test_holm(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,)], "p_value double")
    assert sorted(round(r.p_holm, 6) for r in behaviour.holm(df).collect()) == [0.03, 0.06, 0.06]


def test_resource_thresholds(spark):
    df = spark.createDataFrame([("rss", 1_000_000.0, 1_180_224.0), ("ok", 1_000_000.0, 1_050_000.0), ("zero", 0.0, 0.0)], "name string, b double, c double")
    d = resources.resource_delta(df.select("name", F.col("b").alias("value")), df.select("name", F.col("c").alias("value")), ["name"])
    got = {r.name: (r.mode, r.regression) for r in resources.threshold_decision(d, F.lit(False), F.lit(0.1)).collect()}
    assert got == {"rss": ("threshold", True), "ok": ("threshold", False), "zero": ("threshold", False)}
    none = resources.threshold_decision(d, F.lit(False), F.lit(None).cast("double")).first()
    assert (none.mode, none.regression) == ("none", False)


def test_config_changes(spark):
    b = spark.createDataFrame([("r", '{"loader.workers": 8, "a": 1, "gone": null}')], "run string, conf string")
    c = spark.createDataFrame([("r", '{"loader.workers": 2, "a": 1, "new": true}')], "run string, conf string")
    leaves = lambda df: resources.json_leaves(df, ["run"], "conf")
    assert {(r.path, r.old, r.new, r.change) for r in resources.config_changes(leaves(b), leaves(c), ["run"]).collect()} == {("loader.workers", "8", "2", "changed"), ("gone", None, None, "removed"), ("new", None, "true", "added")}


def table_of(spark, rows, schema="x double, y string"):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"row_idx long, {schema}")


def kinds(df):
    return sorted(r.kind for r in df.collect())


def test_table_parity(spark):
    a = table_of(spark, [(1.0, None), (2.0, "ok")])
    assert kinds(tables.table_parity(a, table_of(spark, [(1.1, ""), (2.0, "ok")]))) == ["null", "precision"]
    assert kinds(tables.table_parity(a, a)) == []
    one, two = table_of(spark, [(1.0, "a"), (2.0, "a")]), table_of(spark, [(2.0, "a"), (1.0, "a")])
    assert kinds(tables.table_parity(one, two)) == ["order", "precision", "precision"]
    assert kinds(tables.table_parity(one, two, check_order=False)) == []
    near = table_of(spark, [(2.0000001, "a"), (1.0, "a")])
    assert kinds(tables.table_parity(one, near, check_order=False, atol=1e-5)) == []
    assert kinds(tables.table_parity(one, near, check_order=False)) == ["value"] * 2
    swapped = one.select("row_idx", "y", "x")
    assert kinds(tables.table_parity(one, swapped)) == ["schema"]
    short = tables.table_parity(one, one.limit(1))
    assert "shape" in kinds(short)
    text = one.withColumn("x", F.col("x").cast("string"))
    assert "type" in kinds(tables.table_parity(one, text))


def leaves(spark, rows):
    return spark.createDataFrame([(1, p, n, s) for p, n, s in rows], "case_id int, path string, num double, str string")


def test_output_parity(spark):
    e = leaves(spark, [("$['probabilities'][0]", 0.5, None), ("$['logits'][0]", 10.0, None), ("$['name']", None, "a"), ("$['old']", 1.0, None)])
    a = leaves(spark, [("$['probabilities'][0]", 0.6, None), ("$['logits'][0]", 10.2, None), ("$['name']", None, "a"), ("$['new']", 1.0, None)])
    got = tables.output_parity(e, a, ["case_id"], {"probabilities": (0.2, 0.0), "logits": (0.1, 0.0)})
    assert {r.path: r.reason for r in got.collect() if r.reason} == {"$['logits'][0]": "value", "$['old']": "missing", "$['new']": "unexpected"}
    case = tables.parity_cases(got, ["case_id"]).first()
    assert not case.passed and case.mismatches == 3
    assert {r.root: r.mismatches for r in tables.per_output(got).collect()}["logits"] == 1
    assert tables.worst_divergences(tables.parity_cases(got, ["case_id"]), ["case_id"]).count() == 1


def test_nan_and_infinity_rules(spark):
    e = leaves(spark, [("a", NAN, None), ("b", INF, None), ("c", INF, None)])
    a = leaves(spark, [("a", NAN, None), ("b", INF, None), ("c", -INF, None)])
    bad = lambda **o: sorted(r.path for r in tables.output_parity(e, a, ["case_id"], **o).collect() if r.reason)
    assert bad() == ["a", "c"] and bad(nan_equal=True) == ["c"] and bad(inf_equal=False) == ["a", "b", "c"]


def test_fingerprint_ignores_order_but_not_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "i int, s string")
    one = tables.table_fingerprint(df, ["i", "s"]).first()
    assert one == tables.table_fingerprint(df.orderBy(F.desc("i")).repartition(3), ["i", "s"]).first() and one.rows == 3
    assert one.multiset_sha256 != tables.table_fingerprint(df.distinct(), ["i", "s"]).first().multiset_sha256
    assert tables.table_fingerprint(df.limit(0), ["i", "s"]).first().rows == 0
    assert {r.column: (r.type, r.nulls) for r in tables.schema_profile(df).collect()} == {"i": ("integer", 0), "s": ("string", 2)}


def test_summaries_leave_out_what_is_not_finite(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", float("inf")), ("a", None), ("b", float("nan"))], "g string, value double")
    rows = {r.g: r for r in resources.summaries(df, ["g"]).collect()}
    assert (rows["a"].n, rows["a"].mean, rows["a"].max, rows["a"].p95, rows["a"].left_out) == (1, 1.0, 1.0, 1.0, 3)
    assert (rows["b"].n, rows["b"].mean, rows["b"].left_out) == (0, None, 1)
    d = resources.resource_delta(df, df.where("g = 'a'"), ["g"]).where("g = 'a'").first()
    assert (d.baseline, d.candidate_n, d.delta) == (1.0, 1, 0.0)


def test_nested_leaves(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": null}], "d": {}}, "e": "x"}'), (2, "3"), (3, None)], "id int, j string")
    got = sorted((r.id, r.path, r.value) for r in resources.nested_leaves(df, ["id"], "j").collect())
    assert [(i, p) for i, p, _ in got] == [(1, "a.b.0"), (1, "a.b.1.c"), (1, "a.d"), (1, "e"), (2, "")]
    assert dict(((i, p), v) for i, p, v in got)[(1, "e")] == "x" and dict(((i, p), v) for i, p, v in got)[(1, "a.b.0")] == "1"


def test_rows_are_numbered_in_order_without_one_task(spark):
    from runlens.checkpoints import numbered

    df = spark.range(500).selectExpr("pmod(id * 7919, 503) AS v", "id").repartition(9)
    got = [tuple(r) for r in numbered(df, ["v", "id"]).orderBy("row_idx").select("v", "row_idx").collect()]
    assert [n for _, n in got] == list(range(500)) and [v for v, _ in got] == sorted(v for v, _ in got)
    assert numbered(df.limit(0), ["v"]).count() == 0


def test_large_groups_are_bootstrapped_by_weights(spark):
    from runlens.operators import statistics

    df = spark.range(400).selectExpr("id % 2 AS g", "id", "cast(id % 10 AS double) AS value")
    drawn, weighed = ({r.g: r for r in statistics.bootstrap(df, ["g"], ["id"], "value", 200, 1, max_draws=m).collect()} for m in (10**9, 10))
    for g in (0, 1):
        assert drawn[g].estimate == weighed[g].estimate and abs(drawn[g].lower - weighed[g].lower) < 0.2 and abs(drawn[g].upper - weighed[g].upper) < 0.2


def best_matching(a, b, tol):
    """The most pairs within the tolerance, by augmenting paths."""
    partner = {}

    def place(i, seen):
        for j, y in enumerate(b):
            if j not in seen and abs(a[i] - y) <= tol:
                seen.add(j)
                if j not in partner or place(partner[j], seen):
                    partner[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(a)))


def test_unordered_parity_of_one_number_is_the_best_matching_of_unequal_rows(spark):
    import random
    from collections import Counter

    rng = random.Random(3)
    a, b = ([(rng.choice("xy"), round(rng.uniform(0, 20), 1)) for _ in range(150)] for _ in range(2))
    a += [("x", None), ("y", float("nan"))]
    b += [("x", 1000.0)] * 3
    left, right = (spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_idx long, k string, v double") for rows in (a, b))
    got = tables.table_parity(left, right, atol=0.25, check_order=False).where("kind = 'value'").collect()
    more, less = Counter(a) - Counter(b), Counter(b) - Counter(a)
    pairs = sum(best_matching([v for q, v in more.elements() if q == k and v is not None and v == v], [v for q, v in less.elements() if q == k], 0.25) for k in "xy")
    assert pairs > 10 and sum(r.reference is not None for r in got) == more.total() - pairs and sum(r.candidate is not None for r in got) == less.total() - pairs
    assert tables.table_parity(left, left, atol=0.25, check_order=False).count() == 0
