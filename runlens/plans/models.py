"""Predictions, slices, resources, tables and nested outputs over the test tables."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.decisions import wilson
from ..functions.values import argmax, resource_higher_is_better
from ..operators import behaviour, resources, tables
from .experiments import dirty_events
from .registry import query, table

Z = NormalDist().inv_cdf(0.975)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models over `embeddings`: the class is the argmax of the first four numbers, or of the next four."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.slice("embedding", 1, 4).alias("baseline"), F.slice("embedding", 5, 4).alias("candidate"), (F.col("label") % 4).alias("label"))


PRED = """e AS (SELECT vec_id, embedding[1:4] AS b, embedding[5:8] AS c, label % 4 AS label FROM embeddings),
p AS (SELECT vec_id, b, c, label, list_position(b, list_max(b)) - 1 AS bc, list_position(c, list_max(c)) - 1 AS cc FROM e)"""
WILSON = f"""greatest(0.0, (r + {Z * Z} / (2 * n)) / (1 + {Z * Z} / n) - {Z} * sqrt(r * (1 - r) / n + {Z * Z} / (4.0 * n * n)) / (1 + {Z * Z} / n)) AS change_low,
least(1.0, (r + {Z * Z} / (2 * n)) / (1 + {Z * Z} / n) + {Z} * sqrt(r * (1 - r) / n + {Z * Z} / (4.0 * n * n)) / (1 + {Z * Z} / n)) AS change_high"""


@query("prediction_changes", f"""WITH {PRED}, a AS (SELECT count(*) AS n, count(*) FILTER (WHERE bc <> cc) AS class_flips, count(*) FILTER (WHERE bc = cc AND b <> c) AS confidence_only,
count(*) FILTER (WHERE bc <> cc AND bc = label) AS flips_to_incorrect, count(*) FILTER (WHERE bc <> cc AND cc = label) AS flips_to_correct, avg((bc = label)::INT) AS baseline_accuracy, avg((cc = label)::INT) AS candidate_accuracy FROM p),
r AS (SELECT *, class_flips / n AS r FROM a)
SELECT * EXCLUDE r, r AS change_rate, {WILSON}, candidate_accuracy - baseline_accuracy AS accuracy_delta FROM r""")
def prediction_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.change_counts(predictions(spark, sf_dir))


@query("wilson_change_rate", f"WITH {PRED}, a AS (SELECT label, count(*) AS n, count(*) FILTER (WHERE bc <> cc) AS flips FROM p GROUP BY label), r AS (SELECT *, flips / n AS r FROM a) SELECT label, n, flips, {WILSON} FROM r")
def wilson_change_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = behaviour.classes(predictions(spark, sf_dir)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("b_class") != F.col("c_class")).alias("flips"))
    low, high = wilson(F.col("flips"), F.col("n"))
    return rows.withColumns({"change_low": low, "change_high": high})


@query("class_tv", f"WITH {PRED}, b AS (SELECT bc AS k, count(*) / (SELECT count(*) FROM p) AS s FROM p GROUP BY 1), c AS (SELECT cc AS k, count(*) / (SELECT count(*) FROM p) AS s FROM p GROUP BY 1) SELECT sum(abs(coalesce(b.s, 0) - coalesce(c.s, 0))) / 2 AS total_variation FROM b FULL JOIN c USING (k)")
def class_tv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.class_shift(behaviour.classes(predictions(spark, sf_dir)))


@query("prediction_classes", f"WITH {PRED} SELECT vec_id, bc AS baseline_class, list_max(b) AS baseline_confidence FROM p")
def prediction_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).select("vec_id", argmax(F.col("baseline")).alias("baseline_class"), F.array_max("baseline").alias("baseline_confidence"))


@query("ece", """WITH s AS (SELECT l_returnflag, CASE WHEN l_discount + 0.5 > 0.5 - l_discount THEN l_discount + 0.5 ELSE 0.5 - l_discount END AS conf, (CASE WHEN l_discount + 0.5 >= 0.5 - l_discount THEN 0 ELSE 1 END = l_linenumber % 2)::INT AS hit FROM lineitem),
b AS (SELECT l_returnflag, least(9, floor(conf * 10)) AS bin, count(*) AS m, avg(conf) AS conf, avg(hit) AS hit FROM s GROUP BY 1, 2)
SELECT l_returnflag, sum(m)::BIGINT AS n, sum(m * abs(conf - hit)) / sum(m) AS ece FROM b GROUP BY 1""")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.array(F.col("l_discount") + 0.5, 0.5 - F.col("l_discount")).alias("scores"), (F.col("l_linenumber") % 2).alias("label"))
    return behaviour.calibration_error(li, "scores", "label", ["l_returnflag"])


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with customer features and two correctness flags."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey)
    return rows.select("o_orderkey", F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), "c_acctbal", (F.col("o_orderkey") % 5 != 0).alias("b_correct"), (F.col("o_custkey") % 4 != 0).alias("c_correct"))


ROWS = "w AS (SELECT o_orderkey, c_mktsegment AS segment, o_orderpriority AS priority, o_orderstatus AS status, c_acctbal, (o_orderkey % 5 <> 0)::INT AS b, (o_custkey % 4 <> 0)::INT AS c FROM orders JOIN customer ON o_custkey = c_custkey)"
SCORES = "count(*) AS support, avg(b) AS baseline_score, avg(c) AS candidate_score, avg(c) - avg(b) AS delta"


@query("slices_categorical", f"WITH {ROWS}, u AS (SELECT 'segment' AS feature, segment AS value, b, c FROM w UNION ALL SELECT 'priority', priority, b, c FROM w UNION ALL SELECT 'status', status, b, c FROM w) SELECT feature || '=' || value AS slice, feature, value, {SCORES} FROM u GROUP BY feature, value HAVING count(*) >= 5")
def slices_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.categorical_slices(order_rows(spark, sf_dir), ["segment", "priority", "status"])


@query("slices_worst", f"WITH {ROWS}, u AS (SELECT 'segment' AS feature, segment AS value, b, c FROM w UNION ALL SELECT 'priority', priority, b, c FROM w UNION ALL SELECT 'status', status, b, c FROM w), s AS (SELECT feature || '=' || value AS slice, {SCORES} FROM u GROUP BY feature, value) SELECT slice, support, round(delta, 9) AS delta FROM s ORDER BY 3, support DESC, slice LIMIT 3")
def slices_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = slices_categorical(spark, sf_dir).withColumn("delta", F.round("delta", 9))
    return behaviour.worst_slices(found, top=3).select("slice", "support", "delta")


@query("slices_numeric", f"""WITH {ROWS}, v AS (SELECT DISTINCT c_acctbal AS v FROM w), q AS (SELECT quantile_disc(v, 0.0) AS q0, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.5) AS q2, quantile_disc(v, 0.75) AS q3, quantile_disc(v, 1.0) AS q4 FROM v),
n AS (SELECT *, (c_acctbal >= q1)::INT + (c_acctbal >= q2)::INT + (c_acctbal >= q3)::INT AS i FROM w, q)
SELECT 'c_acctbal' AS feature, [q0, q1, q2, q3][i + 1] AS lower, [q1, q2, q3, q4][i + 1] AS upper, {SCORES} FROM n GROUP BY ALL HAVING count(*) >= 5""".replace("GROUP BY ALL", "GROUP BY 1, 2, 3"))
def slices_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.numeric_slices(order_rows(spark, sf_dir), "c_acctbal")


@query("slices_pairs", f"""WITH {ROWS}, u AS (SELECT 'priority' AS "left", 'segment' AS "right", priority AS left_value, segment AS right_value, b, c FROM w UNION ALL SELECT 'priority', 'status', priority, status, b, c FROM w UNION ALL SELECT 'segment', 'status', segment, status, b, c FROM w)
SELECT "left", "right", left_value, right_value, {SCORES} FROM u GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5""")
def slices_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.pair_slices(order_rows(spark, sf_dir), ["segment", "priority", "status"])


@query("holm", """WITH p AS (SELECT user_id % 3 AS family, user_id, avg(value) / 1000.0 AS p_value FROM events GROUP BY user_id),
r AS (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p_value) + 1) * p_value AS s FROM p)
SELECT family, user_id, p_value, least(1.0, max(s) OVER (PARTITION BY family ORDER BY p_value ROWS UNBOUNDED PRECEDING)) AS p_holm FROM r""")
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 3).alias("family"), "user_id").agg((F.avg("value") / 1000.0).alias("p_value"))
    return behaviour.holm(p, ["family"])


SPLIT = "ts < TIMESTAMP '2024-01-16'"


@query("resource_summary", f"SELECT event_type, {SPLIT} AS early, count(v) AS n, avg(v) AS mean, min(v) AS min, max(v) AS max, quantile_disc(v, 0.95) AS p95, count(*) - count(v) AS left_out FROM (SELECT *, CASE WHEN event_id % 97 <> 0 AND event_id % 89 <> 0 THEN value END AS v FROM events) GROUP BY 1, 2")
def resource_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = dirty_events(spark, sf_dir).withColumn("early", F.col("ts") < F.lit("2024-01-16").cast("timestamp"))
    return resources.summaries(e, ["event_type", "early"])


@query("resource_regressions", f"""WITH b AS (SELECT event_type AS name, quantile_disc(value, 0.95) AS v FROM events WHERE {SPLIT} GROUP BY 1), c AS (SELECT event_type AS name, quantile_disc(value, 0.95) AS v FROM events WHERE NOT ({SPLIT}) GROUP BY 1),
j AS (SELECT name, b.v AS baseline, c.v AS candidate, c.v - b.v AS delta, CASE WHEN b.v <> 0 THEN (c.v - b.v) / abs(b.v) END AS relative_delta FROM b JOIN c USING (name)),
t AS (SELECT *, CASE WHEN name <> 'view' THEN 0.001 END AS threshold FROM j)
SELECT name, baseline, candidate, delta, relative_delta, CASE WHEN threshold IS NULL THEN 'none' ELSE 'threshold' END AS mode, coalesce(relative_delta > threshold, false) AS regression FROM t""")
def resource_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "value", (F.col("ts") < F.lit("2024-01-16").cast("timestamp")).alias("early"))
    d = resources.resource_delta(e.where("early"), e.where("NOT early"), ["name"], aggregate="p95")
    out = resources.threshold_decision(d, resource_higher_is_better(F.col("name")), F.when(F.col("name") != "view", 0.001))
    return out.select("name", "baseline", "candidate", "delta", "relative_delta", "mode", "regression")


@query("config_diff", """WITH k AS (SELECT user_id, arg_min(props, event_id) AS a, arg_max(props, event_id) AS b FROM events GROUP BY user_id),
x AS (SELECT user_id, unnest(json_keys(a)) AS path, a FROM k), y AS (SELECT user_id, unnest(json_keys(b)) AS path, b FROM k),
o AS (SELECT user_id, path, json_extract_string(a, '$."' || path || '"') AS old, true AS l FROM x), n AS (SELECT user_id, path, json_extract_string(b, '$."' || path || '"') AS new, true AS r FROM y)
SELECT user_id, path, old, new, CASE WHEN l IS NULL THEN 'added' WHEN r IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n USING (user_id, path) WHERE l IS NULL OR r IS NULL OR old IS DISTINCT FROM new""")
def config_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("props", "event_id").alias("a"), F.max_by("props", "event_id").alias("b"))
    return resources.config_changes(resources.json_leaves(e, ["user_id"], "a"), resources.json_leaves(e, ["user_id"], "b"), ["user_id"])


LINES = "l AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS total FROM lineitem GROUP BY 1)"


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("total"))


@query("feature_parity_cells", f"WITH {LINES}, j AS (SELECT o_orderkey, o_totalprice AS a, total AS b FROM orders JOIN l ON o_orderkey = l_orderkey) SELECT o_orderkey AS row_idx, 'total' AS \"column\", 'precision' AS kind FROM j WHERE NOT (abs(a - b) <= 1.0 + 0.5 * greatest(abs(a), abs(b)))")
def feature_parity_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_idx"), F.col("o_totalprice").alias("total"))
    t = totals(spark, sf_dir).select(F.col("l_orderkey").alias("row_idx"), "total")
    return tables.table_parity(o, t, atol=1.0, rtol=0.5).where("kind = 'precision'").select("row_idx", "column", "kind")


@query("multiset_diff", """WITH a AS (SELECT o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 5 <> 0),
u AS (SELECT s, p, 1 AS k FROM a UNION ALL SELECT s, p, -1 FROM b) SELECT s AS status, p AS priority, sum(k)::BIGINT AS surplus FROM u GROUP BY 1, 2 HAVING sum(k) <> 0""")
def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_orderkey")
    d = tables.multiset_difference(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 5 <> 0"), ["status", "priority"])
    return d.select(F.get_json_object("row", "$.status").alias("status"), F.get_json_object("row", "$.priority").alias("priority"), "surplus")


@query("schema_profile", "WITH n AS (SELECT count(*) AS r, count(*) FILTER (WHERE value IS NULL OR isnan(value)) AS v FROM (SELECT CASE WHEN event_id % 97 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 89 = 0 THEN NULL ELSE value END AS value FROM events)) SELECT c AS \"column\", t AS type, CASE WHEN c = 'value' THEN v ELSE 0 END AS nulls, r AS rows, c = 'value' AND v > 0 AS nullable FROM n, (VALUES ('event_id', 'integer'), ('ts', 'datetime'), ('user_id', 'integer'), ('event_type', 'string'), ('value', 'number'), ('props', 'string')) AS x(c, t)")
def schema_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.schema_profile(dirty_events(spark, sf_dir))


@query("table_fingerprint", """WITH h AS (SELECT sha256(c_custkey || chr(31) || c_name || chr(31) || c_mktsegment) AS h, count(*) AS n FROM customer GROUP BY 1),
l AS (SELECT i, sum(n::HUGEINT * ('0x' || substr(h, 1 + 8 * i, 8))::HUGEINT) AS s FROM h, range(8) AS t(i) GROUP BY i)
SELECT (SELECT sum(n)::BIGINT FROM h) AS rows, sha256((SELECT sum(n)::BIGINT FROM h) || ',' || string_agg(s::VARCHAR, ',' ORDER BY i)) AS multiset_sha256 FROM l""")
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table_fingerprint(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_mktsegment"])


@query("output_parity", """WITH e AS (SELECT vec_id, i, embedding[i] AS x, embedding[i] * CASE WHEN (vec_id + i) % 10 = 0 THEN 1.1 ELSE 1.0000001 END AS y FROM embeddings, range(1, 5) AS t(i)),
l AS (SELECT vec_id, i, x::DOUBLE AS x, y::DOUBLE AS y, NOT (abs(x::DOUBLE - y::DOUBLE) <= 1e-6 + 1e-5 * abs(x::DOUBLE)) AS bad FROM e)
SELECT vec_id, NOT bool_or(bad) AS passed, count(*) FILTER (WHERE bad) AS mismatches, '$[''scores''][' || (min(i) FILTER (WHERE bad) - 1) || ']' AS first_path FROM l GROUP BY vec_id""")
def output_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 4)).alias("i", "x"))
    path = F.concat(F.lit("$['scores']["), F.col("i").cast("string"), F.lit("]"))
    none = F.lit(None).cast("string")
    factor = F.when((F.col("vec_id") + F.col("i") + 1) % 10 == 0, 1.1).otherwise(1.0000001)
    expected = e.select("vec_id", path.alias("path"), F.col("x").cast("double").alias("num"), none.alias("str"))
    actual = e.select("vec_id", path.alias("path"), (F.col("x") * factor).cast("double").alias("num"), none.alias("str"))
    return tables.parity_cases(tables.output_parity(expected, actual, ["vec_id"]), ["vec_id"]).select("vec_id", "passed", "mismatches", "first_path")


@query("first_divergence", """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_type AS name, value FROM events),
c AS (SELECT user_id, seq, CASE WHEN (user_id + seq) % 53 = 0 THEN 'other' ELSE name END AS cn, value + CASE WHEN (user_id * seq) % 61 = 0 THEN 1 ELSE 0 END AS cv, name, value FROM e),
b AS (SELECT user_id, seq, CASE WHEN cn <> name THEN 'name' WHEN abs(cv - value) > 1e-6 + 1e-5 * abs(value) THEN 'value' END AS reason FROM c)
SELECT user_id, min(seq) AS seq, arg_min(reason, seq) AS reason FROM b WHERE reason IS NOT NULL GROUP BY user_id""")
def first_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("seq"), F.col("event_type").alias("name"), "value")
    c = e.withColumns({"name": F.when((F.col("user_id") + F.col("seq")) % 53 == 0, "other").otherwise(F.col("name")), "value": F.col("value") + F.when((F.col("user_id") * F.col("seq")) % 61 == 0, 1).otherwise(0)})
    return tables.first_divergence(e, c, ["user_id"])


@query("tensor_stats", "SELECT label, count(*) AS elements, min(x) AS min, max(x) AS max, avg(x) AS mean, stddev_pop(x) AS std, 1.0 AS finite_fraction, sqrt(sum(x * x)) AS norm FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label")
def tensor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import trace

    return trace.tensor_stats(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
