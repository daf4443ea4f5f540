"""Evidence upkeep over the test tables: merges, identities, calibration and resource intervals, readers, failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import is_null_like, output_root, type_family
from ..operators import behaviour, failures, inputs, lineage, pairing, readers, statistics, tables
from ..sources import capsules
from .experiments import BOUNDS, resamples_sql
from .models import PRED, predictions
from .registry import query, table


@query("calibration_interval", """WITH s AS (SELECT 0 AS g, event_id, 0.5 + (event_id % 50) / 100.0 AS bc, (event_id % 3 <> 0)::INT AS bh, 0.5 + (event_id % 37) / 100.0 AS cc, (event_id % 3 <> 0)::INT AS ch FROM events),
i AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM s), d AS (SELECT r, CAST('0x' || substr(md5('2:' || r || ':' || i), 1, 8) AS BIGINT) % n AS i FROM i, range(40) AS t(r)),
x AS (SELECT r, -1.0 AS sign, bc AS conf, bh AS hit FROM d JOIN i USING (i) UNION ALL SELECT r, 1.0, cc, ch FROM d JOIN i USING (i)),
b AS (SELECT r, sign, least(9, floor(conf * 10)) AS bin, count(*) AS m, avg(conf) AS conf, avg(hit) AS hit FROM x GROUP BY 1, 2, 3), e AS (SELECT r, 2 * sum(sign * m * abs(conf - hit)) / sum(m) AS s FROM b GROUP BY r)
SELECT """ + BOUNDS + " FROM e")
def calibration_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    score = lambda m: F.lit(0.5) + (F.col("event_id") % m) / 100.0
    rows = e.select("event_id", F.array(score(50), 1 - score(50)).alias("b"), F.array(score(37), 1 - score(37)).alias("c"), F.when(F.col("event_id") % 3 != 0, 0).otherwise(1).alias("label"))
    return behaviour.calibration_interval(rows, "b", "c", "label", "event_id", 40, 2)


@query("resource_interval", f"""WITH p AS (SELECT event_type AS name, event_id, value FROM events WHERE ts < TIMESTAMP '2024-01-16'), q AS (SELECT event_type AS name, event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-16'),
{resamples_sql('p', 'name', 'value', 'event_id', 30, 1, '1').replace('avg(value) AS s', 'quantile_disc(value, 0.95) AS s')}, {resamples_sql('q', 'name', 'value', 'event_id', 30, 2, '2').replace('avg(value) AS s', 'quantile_disc(value, 0.95) AS s')},
d AS (SELECT name, s2.s - s1.s AS s FROM s1 JOIN s2 USING (name, r)) SELECT name, {BOUNDS} FROM d GROUP BY name""")
def resource_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "name")
    out = statistics.independent_bootstrap(e.where("ts < '2024-01-16'"), e.where("ts >= '2024-01-16'"), ["name"], ["event_id"], "value", 30, 1, aggregate="p95")
    return out.select("name", "lower", "upper", "p_value")


def _poisson_sql() -> str:
    import math

    bounds = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(9)]
    return "CASE " + " ".join(f"WHEN u < {b!r} THEN {k}" for k, b in enumerate(bounds)) + " ELSE 9 END"


@query("poisson_bootstrap", f"""WITH u AS (SELECT event_type AS name, value, r, CAST('0x' || substr(md5('4:' || r || ':' || event_id), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0 AS u FROM events, range(50) AS t(r)),
w AS (SELECT name, r, value, {_poisson_sql()} AS w FROM u), s AS (SELECT name, r, sum(w * value) / sum(w) AS s FROM w GROUP BY 1, 2), e AS (SELECT event_type AS name, count(*) AS n, avg(value) AS estimate FROM events GROUP BY 1)
SELECT name, any_value(n) AS n, any_value(estimate) AS estimate, {BOUNDS} FROM s JOIN e USING (name) GROUP BY name""")
def poisson_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "name")
    return statistics.poisson_bootstrap(e, ["name"], "event_id", "value", 50, 4)


@query("merged_evidence", """WITH u AS (SELECT user_id, event_id AS pos, event_type, 0 AS k FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_id, event_type, 1 FROM events WHERE event_id % 3 = 0)
SELECT user_id, arg_min(pos, (k, pos)) AS pos, arg_max(event_type, (k, pos)) AS event_type FROM u GROUP BY user_id""")
def merged_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), "event_type")
    return pairing.merge_identified(e.where("pos % 2 = 0"), e.where("pos % 3 = 0"), ["user_id"])


IDENTITY = """i AS (SELECT user_id, event_type, event_id, CASE WHEN event_id % 4 = 0 THEN 'e' || event_id END AS x, CASE WHEN event_id % 3 = 0 THEN event_id END AS s, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS p FROM events),
k AS (SELECT *, coalesce(x, s::VARCHAR, p::VARCHAR) AS identity, CASE WHEN x IS NOT NULL THEN 'declared' WHEN s IS NOT NULL THEN 'step' ELSE 'position' END AS identity_kind FROM i)"""


def identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("x"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("s"))
    return pairing.observation_identity(e, ["user_id", "event_type"], ["event_id"], "x", "s")


@query("observation_identity", f"WITH {IDENTITY} SELECT event_id, identity, identity_kind FROM k")
def observation_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(spark, sf_dir).select("event_id", "identity", "identity_kind")


@query("series_identity", f"WITH {IDENTITY} SELECT user_id, event_type, CASE WHEN count(DISTINCT identity_kind) > 1 THEN 'mixed' ELSE any_value(identity_kind) END AS identity_kind FROM k GROUP BY 1, 2")
def series_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.series_identity_kind(identified(spark, sf_dir), ["user_id", "event_type"])


@query("unpaired_keys", "WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 1) SELECT user_id, event_type, 'missing' AS side FROM a ANTI JOIN b USING (user_id, event_type) UNION ALL SELECT user_id, event_type, 'unexpected' FROM b ANTI JOIN a USING (user_id, event_type)")
def unpaired_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return pairing.symmetric_difference(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"])


@query("per_output_errors", f"WITH {PRED}, l AS (SELECT i, b[i]::DOUBLE AS x, c[i]::DOUBLE AS y FROM p, range(1, 5) AS t(i)) SELECT CASE WHEN i <= 2 THEN 'head' ELSE 'tail' END AS root, count(*) AS leaves, count(*) FILTER (WHERE NOT (abs(x - y) <= CASE WHEN i <= 2 THEN 0.5 ELSE 0.1 END)) AS mismatches, max(abs(x - y)) AS max_abs_error, max(CASE WHEN x <> 0 THEN abs(x - y) / abs(x) END) AS max_rel_error FROM l GROUP BY 1")
def per_output_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    root = F.when(F.col("i") < 2, "head").otherwise("tail")
    leaf = lambda c: p.select("vec_id", F.posexplode(c).alias("i", "x")).select("vec_id", F.concat(F.lit("$['"), root, F.lit("']["), F.col("i").cast("string"), F.lit("]")).alias("path"), F.col("x").cast("double").alias("num"), F.lit(None).cast("string").alias("str"))
    return tables.per_output(tables.output_parity(leaf("baseline"), leaf("candidate"), ["vec_id"], {"head": (0.5, 0.0), "tail": (0.1, 0.0)}))


@query("output_roots", "SELECT p_brand AS path, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN 'b' || p_size ELSE '$' END AS root, count(*) AS n FROM part GROUP BY 1, 2")
def output_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    path = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("$['"), "p_brand", F.lit("'][2]"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("$.b"), size, F.lit(".c"))).otherwise(F.concat(F.lit("$["), size, F.lit("]")))
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("path"), output_root(path).alias("root")).agg(F.count(F.lit(1)).alias("n"))


FAILURES = """f AS (SELECT user_id, ['', 'builtins.', 'a.', 'b.'][1 + event_id % 4] AS module, event_type AS name, event_id % 5 AS m FROM events)"""


def raised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a failure: its type's module goes by the event, its phase is one of five."""
    none = F.lit(None).cast("string")
    module = F.element_at(F.array(*[F.lit(x) for x in ("", "builtins.", "a.", "b.")]), (F.col("event_id") % 4 + 1).cast("int"))
    message = F.concat(F.lit("row "), F.col("event_id").cast("string"), F.lit(" failed"))
    return table(spark, sf_dir, "events").select("user_id", F.lit("exception").alias("kind"), F.concat(module, F.col("event_type")).alias("error_type"), message.alias("message"), (F.col("event_id") % 5).cast("string").alias("phase"), none.alias("module"), none.alias("operation"), none.alias("top_frame"))


@query("failure_matches", f"""WITH {FAILURES}, e AS (SELECT user_id, module, name, CASE WHEN m <> 0 THEN m END AS m, count(*) AS k FROM f GROUP BY ALL), o AS (SELECT module, name, m, count(*) AS k FROM f GROUP BY ALL)
SELECT e.user_id AS expected_id, sum(o.k)::BIGINT AS matched FROM (SELECT DISTINCT user_id, module, name, m FROM e) e JOIN o ON e.name = o.name AND (e.m IS NULL OR o.m = e.m) AND (e.module = o.module OR e.module IN ('', 'builtins.') OR o.module IN ('', 'builtins.')) GROUP BY 1""")
def failure_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many failures each user's kinds of failure match, over all events; observed ones are grouped first."""
    f = raised(spark, sf_dir)
    keys = ["kind", "error_type", "message", "phase", "module", "operation", "top_frame"]
    observed = f.drop("user_id").withColumn("message", failures.normalise_message(F.col("message"))).groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).withColumn("id", F.xxhash64(*keys))
    expected = f.withColumn("phase", F.when(F.col("phase") != "0", F.col("phase"))).withColumnRenamed("user_id", "id").withColumn("message", failures.normalise_message(F.col("message"))).select("id", *keys).distinct()
    found = failures.matches(expected, observed)
    return found.join(observed.select(F.col("id").alias("observed_id"), "k"), "observed_id").groupBy("expected_id").agg(F.sum("k").alias("matched"))


@query("traceback_signatures", "SELECT event_type || 'Error' AS error_type, 'value ' || user_id AS message, count(*) AS n FROM events GROUP BY 1, 2")
def traceback_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Traceback (most recent call last):\n  File \"a.py\", line 3\n"), "event_type", F.lit("Error: value "), F.col("user_id").cast("string"), F.lit("\nchild exited with 1\n"))
    kind, message = failures.from_traceback(text)
    return table(spark, sf_dir, "events").groupBy(kind.alias("error_type"), message.alias("message")).agg(F.count(F.lit(1)).alias("n"))


@query("reader_formats", "SELECT CASE p_size % 4 WHEN 0 THEN 'sql' WHEN 1 THEN 'python' WHEN 2 THEN 'notebook' ELSE 'dvc' END AS reader, count(*) AS n FROM part GROUP BY 1")
def reader_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("d/"), F.element_at(F.array(*[F.lit(x) for x in ("a.sql", "b.py", "c.ipynb", "dvc.yaml")]), F.col("p_size") % 4 + 1))
    return table(spark, sf_dir, "part").groupBy(lineage.reader_of(path).alias("reader")).agg(F.count(F.lit(1)).alias("n"))


@query("python_lineage", "SELECT p_partkey::VARCHAR AS id, 'mod_' || p_size || '.sub' AS name, 'imports' AS relation FROM part UNION ALL SELECT p_partkey::VARCHAR, 'data/' || p_size || '.csv', 'reads' FROM part UNION ALL SELECT p_partkey::VARCHAR, 'f' || p_size, 'defines_function' FROM part")
def python_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size").cast("string")
    text = F.concat(F.lit("import mod_"), s, F.lit(".sub\ndef f"), s, F.lit("():\n    return pd.read_csv('data/"), s, F.lit(".csv')\n"))
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), text.alias("text"), F.lit("python").alias("reader"))
    return readers.read_sources(files, reader_col="reader").select("id", "name", "relation")


@query("pipeline_lineage", "SELECT p_partkey::VARCHAR AS id, 'in/' || p_size || '.csv' AS name, 'reads' AS relation FROM part UNION ALL SELECT p_partkey::VARCHAR, 'out/' || p_size || '.json', 'writes' FROM part UNION ALL SELECT p_partkey::VARCHAR, 'run.py', 'runs' FROM part")
def pipeline_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size").cast("string")
    text = F.concat(F.lit("stages:\n  one:\n    cmd: python run.py\n    deps:\n      - in/"), s, F.lit(".csv\n    outs: [out/"), s, F.lit(".json]\n"))
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), text.alias("text"), F.lit("dvc").alias("reader"))
    return readers.read_sources(files, reader_col="reader").select("id", "name", "relation")


@query("content_store", "SELECT DISTINCT sha256(c_mktsegment) AS sha256, 'sha256/' || substr(sha256(c_mktsegment), 1, 2) || '/' || sha256(c_mktsegment) AS key FROM customer")
def content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").cast("binary").alias("content"))
    return capsules.put_content(c).select("sha256", "key")


@query("null_cells", "SELECT count(*) FILTER (WHERE event_id % 97 = 0 OR event_id % 89 = 0) AS nulls, 'number' AS family FROM events")
def null_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .experiments import dirty_events

    e = dirty_events(spark, sf_dir)
    dtype = e.schema["value"].dataType
    return e.agg(F.count_if(is_null_like(F.col("value"), dtype)).alias("nulls")).withColumn("family", F.lit(type_family(dtype)))


@query("input_cases")
def input_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.input_cases(spark, 4, seed=1, include_non_finite=True).orderBy("case_id")


@query("exact_bootstrap")
def exact_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .experiments import paired

    return statistics.exact_bootstrap(paired(spark, sf_dir), ["name"], ["token"], "difference", 100, 7)
