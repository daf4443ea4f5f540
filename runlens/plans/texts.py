"""Nested values, models, readers, envelopes, events and reports over the test tables."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.redaction import redact_value
from ..functions.values import identity_token
from ..operators import failures, lineage, nested, operations, readers, tables, trace
from ..sources.capsules import canonical_json
from .registry import query, table


def nested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a JSON value with nested members, a list, and a secret now and then."""
    i = F.col("event_id")
    body = F.struct(F.struct(F.col("value").alias("v"), F.array(i, i + 1).alias("ids")).alias("m"), F.when(i % 5 == 0, F.lit("hidden")).alias("api_token"), F.when(i % 7 == 0, F.lit("Bearer abc")).alias("note"))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(body).alias("json"))


@query("nested_leaves", """SELECT event_id::VARCHAR AS case_id, '$[''m''][''ids''][' || k || ']' AS path, (event_id + k)::DOUBLE AS num, 'number' AS leaf_type FROM events, range(2) AS t(k) UNION ALL SELECT event_id::VARCHAR, '$[''api_token'']', NULL, 'string' FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_id::VARCHAR, '$[''note'']', NULL, 'string' FROM events WHERE event_id % 7 = 0
UNION ALL SELECT event_id::VARCHAR, '$[''m''][''v'']', value, 'number' FROM events WHERE value IS NOT NULL""")
def nested_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.leaves(nested_events(spark, sf_dir), "event_id", "json").select("case_id", "path", "num", "leaf_type")


@query("nested_profile", "SELECT event_id::VARCHAR AS case_id, (2 + (value IS NOT NULL)::INT + (event_id % 5 = 0)::INT + (event_id % 7 = 0)::INT)::BIGINT AS elements, NULL::VARCHAR AS shape FROM events UNION ALL SELECT 'e' || vec_id, 4::BIGINT, '2,2' FROM embeddings")
def nested_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("e"), F.col("vec_id").cast("string")).alias("event_id"), F.to_json(F.array(F.slice("embedding", 1, 2), F.slice("embedding", 3, 2))).alias("json"))
    return nested.profile(nested_events(spark, sf_dir).withColumn("event_id", F.col("event_id").cast("string")).unionByName(grids), "event_id", "json")


@query("nested_secrets", "SELECT event_id::VARCHAR AS case_id, '$[''api_token'']' AS path, 'secret-key' AS kind FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_id::VARCHAR, '$[''note'']', 'bearer-token' FROM events WHERE event_id % 7 = 0")
def nested_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.scan_json(nested_events(spark, sf_dir), "event_id", "json")


@query("redacted_leaves", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '<redacted>' WHEN event_id % 3 = 1 THEN 'Bearer <redacted>' ELSE event_type END AS value FROM events")
def redacted_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    key = F.when(i % 6 == 0, "DB-Password").when(i % 6 == 3, "client.secret").otherwise("name")
    value = F.when(i % 3 == 1, "Bearer abc.def").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", redact_value(key, value).alias("value"))


@query("identity_tokens", """SELECT event_id, event_id::VARCHAR AS whole, CASE WHEN event_id % 2 = 0 THEN event_id || '.0' ELSE (event_id + 0.5)::DOUBLE::VARCHAR END AS number, '"' || event_type || '"' AS text, CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END AS flag FROM events""")
def identity_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    number = F.when(i % 2 == 0, i.cast("double")).otherwise(i + 0.5)
    return table(spark, sf_dir, "events").select("event_id", identity_token(i, T.LongType()).alias("whole"), identity_token(number, T.DoubleType()).alias("number"), identity_token(F.col("event_type"), T.StringType()).alias("text"), identity_token(i % 3 == 0, T.BooleanType()).alias("flag"))


def _double(x: Any) -> Any:
    if x["n"] % 11 == 0:
        raise ValueError("no reference")
    return {"y": x["n"] * 2}


def _nearly_double(x: Any) -> Any:
    if x["n"] % 7 == 0:
        raise RuntimeError("no candidate")
    return {"y": x["n"] * 2 + (1 if x["n"] % 5 == 0 else 0)}


@query("model_comparison", "SELECT p_partkey::VARCHAR AS case_id, CASE WHEN p_partkey % 11 = 0 THEN 'inconclusive' WHEN p_partkey % 7 = 0 THEN 'error' WHEN p_partkey % 5 = 0 THEN 'fail' ELSE 'pass' END AS status FROM part")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.col("p_partkey").alias("n"))).alias("input"))
    rows, _ = nested.compare_models(cases, _double, _nearly_double, "p_partkey", default=(0.0, 0.0))
    return rows.select("case_id", "status")


@query("non_finite_leaves", "SELECT event_id, '$' AS path, CASE event_id % 4 WHEN 0 THEN 'nan' WHEN 1 THEN 'pos_inf' ELSE 'neg_inf' END AS state FROM events WHERE event_id % 4 <> 3")
def non_finite_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    num = F.when(i % 4 == 0, float("nan")).when(i % 4 == 1, float("inf")).when(i % 4 == 2, float("-inf")).otherwise(1.0)
    return trace.non_finite(table(spark, sf_dir, "events").select("event_id", F.lit("$").alias("path"), num.alias("num")), ["event_id"], "num")


@query("capsule_digests", """WITH m AS (SELECT c_nationkey AS capsule, 'f' || c_custkey AS member, sha256(c_name) AS sha256 FROM customer) SELECT 'n' || capsule AS capsule, sha256('[' || string_agg('{"member":"' || member || '","sha256":"' || sha256 || '"}', ',' ORDER BY member) || ']') AS sha256 FROM m GROUP BY capsule""")
def capsule_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("capsule"), F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("member"), F.sha2("c_name", 256).alias("sha256"))
    return nested.capsule_digest(members)


@query("worst_divergences", "WITH e AS (SELECT vec_id, abs(embedding[1] - embedding[2])::DOUBLE AS d FROM embeddings WHERE embedding[1] <> embedding[2]) SELECT vec_id FROM e ORDER BY d DESC, vec_id LIMIT 10")
def worst_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.abs(F.col("embedding")[0] - F.col("embedding")[1]).cast("double").alias("max_abs_error"), (F.col("embedding")[0] == F.col("embedding")[1]).alias("passed"), F.lit(0.0).alias("max_rel_error"))
    return tables.worst_divergences(e, ["vec_id"], 10).select("vec_id")


@query("top_mismatches", "SELECT kind, row_idx FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'value' ELSE 'null' END AS kind, o_orderkey AS row_idx FROM orders) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY row_idx) <= 7")
def top_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, "value").otherwise("null").alias("kind"), F.col("o_orderkey").alias("row_idx"), F.lit("c").alias("column"))
    return tables.top_mismatches(cells, 7).select("kind", "row_idx")


def _sources(spark: SparkSession, sf_dir: str, reader: str, text: Any) -> DataFrame:
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), text.alias("text"), F.lit(reader).alias("reader"))
    return readers.read_sources(files, reader_col="reader").select("id", "name", "relation")


@query("shell_lineage", "WITH p AS (SELECT p_partkey::VARCHAR AS id, p_size AS s FROM part) SELECT id, 'in/' || s || '.csv' AS name, 'reads' AS relation FROM p UNION ALL SELECT id, 'out/' || s || '.json', 'writes' FROM p UNION ALL SELECT id, 'fit.py', 'runs' FROM p UNION ALL SELECT id, 'log.txt', 'writes' FROM p")
def shell_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size").cast("string")
    return _sources(spark, sf_dir, "shell", F.concat(F.lit("# fit\npython fit.py --data in/"), s, F.lit(".csv \\\n  --out=out/"), s, F.lit(".json > log.txt\n")))


@query("notebook_lineage", "WITH p AS (SELECT p_partkey::VARCHAR AS id, p_size AS s FROM part) SELECT id, 't' || s AS name, 'reads' AS relation FROM p UNION ALL SELECT id, 'raw/' || s || '.csv', 'reads' FROM p UNION ALL SELECT id, 'lib.m' || s, 'imports' FROM p UNION ALL SELECT id, 'go.sh', 'runs' FROM p")
def notebook_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size").cast("string")
    cell = lambda kind, *lines: F.struct(F.lit(kind).alias("cell_type"), F.array(*lines).alias("source"))
    cells = F.array(cell("markdown", F.lit("import nothing")), cell("code", F.lit("%%sql\n"), F.concat(F.lit("SELECT * FROM t"), s)), cell("code", F.concat(F.lit("import lib.m"), s, F.lit("\n")), F.concat(F.lit("d = pd.read_csv('raw/"), s, F.lit(".csv')\n")), F.lit("!bash go.sh")))
    return _sources(spark, sf_dir, "notebook", F.to_json(F.struct(cells.alias("cells"))))


@query("names_of_modules", "SELECT p_partkey, replace(p_brand, '#', '_') || '.m' || p_size AS module, p_size % 2 = 0 AS dynamic FROM part")
def names_of_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand, s = F.regexp_replace("p_brand", "#", "_"), F.col("p_size").cast("string")
    path = F.concat(F.lit("./"), brand, F.lit("/m"), s, F.when(F.col("p_size") % 3 == 0, "/__init__.py").otherwise(".py"))
    name = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("data/${x}/"), s)).otherwise("data/x")
    return table(spark, sf_dir, "part").select("p_partkey", lineage.module_name(path).alias("module"), lineage.looks_dynamic(name).alias("dynamic"))


@query("last_envelopes", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 'E' || (event_id % 3) END AS error_type FROM events")
def last_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 3
    line = lambda i: F.concat(F.lit('{"failure": {"error_type": "E'), F.lit(i).cast("string"), F.lit('"}}'))
    text = F.concat_ws("\n", F.lit("started"), F.when(n >= 1, line(1)), F.lit("{broken"), F.when(n >= 2, line(2)), F.lit('{"other": 1}'))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(failures.last_envelope(text), "$.failure.error_type").alias("error_type"))


@query("openlineage_out", """WITH e AS (SELECT 'job' || n_nationkey AS job, 'r' || n_regionkey AS i, 'n' || n_nationkey AS o FROM nation), h AS (SELECT *, md5('runlens' || chr(31) || job || chr(31) || i || chr(31) || o) AS h FROM e)
SELECT job, '{"eventType":"COMPLETE","inputs":[{"name":"' || i || '","namespace":"runlens"}],"job":{"name":"' || job || '","namespace":"runlens"},"outputs":[{"name":"' || o || '","namespace":"runlens"}],"run":{"runId":"' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-8' || substr(h, 18, 3) || '-' || substr(h, 21, 12) || '"}}' AS event FROM h""")
def openlineage_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    job = name("job", "n_nationkey")
    return table(spark, sf_dir, "nation").select(job.alias("job"), lineage.openlineage_event(job, F.array(name("r", "n_regionkey")), F.array(name("n", "n_nationkey"))).alias("event"))


@query("audit_log", """SELECT '{"action":"put","detail":"Bearer <redacted>, ' || user_id || '","event_id":' || event_id || '}' AS value FROM events""")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = table(spark, sf_dir, "events").select("event_id", F.lit("put").alias("action"), F.concat(F.lit("Bearer tok"), F.col("event_id").cast("string"), F.lit(", "), F.col("user_id").cast("string")).alias("detail"))
    return operations.audit_events(actions, ["detail"])


@query("canonical_texts", """SELECT c_custkey, '{"a":[1,' || c_custkey || '],"b":"' || c_name || '"}' AS canonical FROM customer""")
def canonical_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(source: Any) -> Any:
        for pdf in source:
            yield pdf.assign(canonical=[canonical_json(json.loads(t)) for t in pdf.pop("text")])

    text = F.concat(F.lit('{ "b": "'), "c_name", F.lit('", "a": [1, '), F.col("c_custkey").cast("string"), F.lit("]}"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")).mapInPandas(run, "c_custkey long, canonical string")
