"""Traces, graphs, retention, queues, bisection, lineage and text over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import numbered
from ..functions.redaction import SECRET_PATTERNS, redact_text, scan
from ..functions.values import parity_passed
from ..operators import bisection, dependencies, failures, inputs, lineage, minimise, operations, trace
from .experiments import resamples_sql
from .registry import query, table


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a trace per user: an error is abnormal, and an event's parent is the user's previous one within six hours."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("abnormal"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    near = F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts")) <= 6 * 3600 * 1_000_000
    return e.withColumn("parent", F.when(near, F.lag("event_id").over(w)))


TRACE = "e AS (SELECT user_id, event_id, ts, event_type = 'error' AS abnormal, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 21600000000 THEN lag(event_id) OVER w END AS parent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query("first_abnormal", "SELECT user_id, min(event_id) FILTER (WHERE event_type = 'error') AS first_abnormal, count(*) AS events FROM events GROUP BY user_id")
def first_abnormal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.first_abnormal(trace_events(spark, sf_dir), ["user_id"], "event_id")


@query("trace_window", f"WITH {TRACE}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM e), a AS (SELECT *, min(i) FILTER (WHERE abnormal) OVER (PARTITION BY user_id) AS k FROM p) SELECT user_id, event_id, (i - k)::INT AS \"offset\" FROM a WHERE abs(i - k) <= 3")
def trace_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.around(trace_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], radius=3).select("user_id", "event_id", "offset")


@query("trace_ring", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id, greatest(n - 20, 0) AS dropped FROM r WHERE k <= 20")
def trace_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.ring(trace_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], 20).select("user_id", "event_id", "dropped")


@query("trace_ancestry", f"""WITH RECURSIVE {TRACE}, s AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS node FROM e WHERE abnormal GROUP BY user_id),
a AS (SELECT user_id, node, 0 AS depth FROM s UNION ALL SELECT a.user_id, e.parent, a.depth + 1 FROM a JOIN e ON e.user_id = a.user_id AND e.event_id = a.node WHERE e.parent IS NOT NULL)
SELECT user_id, node, depth FROM a""")
def trace_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = trace_events(spark, sf_dir)
    starts = e.where("abnormal").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("node"))
    return trace.ancestry(e.select("user_id", F.col("event_id").alias("node"), "parent"), starts, ["user_id"])


@query("missing_parents", f"WITH {TRACE}, k AS (SELECT * FROM e WHERE event_id % 7 <> 0) SELECT DISTINCT k.user_id, k.parent FROM k LEFT JOIN k q ON q.user_id = k.user_id AND q.event_id = k.parent WHERE k.parent IS NOT NULL AND q.event_id IS NULL")
def missing_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = trace_events(spark, sf_dir).where("event_id % 7 <> 0").withColumn("parents", F.when(F.col("parent").isNotNull(), F.array("parent")))
    return trace.missing_parents(kept, "parents", "event_id", ["user_id"])


@query("trace_merge", "WITH u AS (SELECT user_id, event_type, event_id, 0 AS s FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_type, event_id, 1 FROM events WHERE event_id % 3 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY s, event_id) AS k FROM u) SELECT user_id, event_type, event_id FROM r WHERE k = 1")
def trace_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return trace.merge_traces(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0"), ["user_id", "event_type"], "event_id")


@query("checkpoint_steps", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_id % 5 = 0) SELECT user_id, event_id FROM r WHERE k <= 3")
def checkpoint_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.every_kth(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", 5, 3)


@query("missing_steps", "WITH d AS (SELECT user_id, min(day(ts)) AS a, max(day(ts)) AS b FROM events GROUP BY 1), n AS (SELECT user_id, unnest(range(a, b + 1))::INT AS step FROM d) SELECT user_id, step FROM n ANTI JOIN (SELECT user_id, day(ts)::INT AS step FROM events) USING (user_id, step)")
def missing_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select("user_id", F.dayofmonth("ts").alias("step"))
    return trace.missing_steps(days.groupBy("user_id").agg(F.min("step").alias("a"), F.max("step").alias("b")), ["user_id"], "a", "b", days)


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes): orders depend on customers, these and suppliers on nations, nations on regions."""
    t = lambda n: table(spark, sf_dir, n)
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    edge = lambda df, sk, s, tk, d: df.select(name(sk, s).alias("source"), name(tk, d).alias("target"), F.lit(tk).alias("kind"))
    edges = edge(t("orders"), "model", "o_orderkey", "feature", "o_custkey").unionByName(edge(t("customer"), "feature", "c_custkey", "dataset", "c_nationkey")).unionByName(edge(t("supplier"), "file", "s_suppkey", "dataset", "s_nationkey")).unionByName(edge(t("nation"), "dataset", "n_nationkey", "region", "n_regionkey"))
    node = lambda df, kind, c: df.select(name(kind, c).alias("id"), F.lit(kind).alias("kind"))
    nodes = node(t("orders"), "model", "o_orderkey").unionByName(node(t("customer"), "feature", "c_custkey")).unionByName(node(t("supplier"), "file", "s_suppkey")).unionByName(node(t("nation"), "dataset", "n_nationkey")).unionByName(node(t("region"), "region", "r_regionkey"))
    return edges, nodes


GRAPH = """g AS (SELECT 'model:' || o_orderkey AS source, 'feature:' || o_custkey AS target, 'feature' AS kind FROM orders UNION ALL SELECT 'feature:' || c_custkey, 'dataset:' || c_nationkey, 'dataset' FROM customer
UNION ALL SELECT 'file:' || s_suppkey, 'dataset:' || s_nationkey, 'dataset' FROM supplier UNION ALL SELECT 'dataset:' || n_nationkey, 'region:' || n_regionkey, 'region' FROM nation)"""
NODES = "n AS (SELECT 'model:' || o_orderkey AS id, 'model' AS kind FROM orders UNION ALL SELECT 'feature:' || c_custkey, 'feature' FROM customer UNION ALL SELECT 'file:' || s_suppkey, 'file' FROM supplier UNION ALL SELECT 'dataset:' || n_nationkey, 'dataset' FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'region' FROM region)"
DOWN = "c AS (SELECT 'region:1' AS id, 0 AS distance UNION ALL SELECT g.source, c.distance + 1 FROM c JOIN g ON g.target = c.id), a AS (SELECT id, min(distance) AS distance FROM c GROUP BY id)"


def _one(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


def affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependencies.closure(graph(spark, sf_dir)[0], _one(spark, "region:1"))


@query("impact_downstream", f"WITH RECURSIVE {GRAPH}, {DOWN} SELECT id, distance FROM a")
def impact_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return affected(spark, sf_dir)


@query("impact_upstream", f"WITH RECURSIVE {GRAPH}, c AS (SELECT unnest(['model:1', 'file:2']) AS id, 0 AS distance UNION ALL SELECT g.target, c.distance + 1 FROM c JOIN g ON g.source = c.id) SELECT id, min(distance) AS distance FROM c GROUP BY id")
def impact_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependencies.closure(graph(spark, sf_dir)[0], _one(spark, "model:1", "file:2"), downstream=False)


@query("impact_distance", f"WITH RECURSIVE {GRAPH}, {NODES}, {DOWN} SELECT kind, distance, count(*) AS nodes FROM a JOIN n USING (id) GROUP BY 1, 2")
def impact_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return affected(spark, sf_dir).join(graph(spark, sf_dir)[1], "id").groupBy("kind", "distance").agg(F.count(F.lit(1)).alias("nodes"))


@query("direct_dependents", f"WITH {GRAPH} SELECT DISTINCT target AS node, source AS neighbour FROM g WHERE target LIKE 'dataset:%'")
def direct_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = graph(spark, sf_dir)
    return dependencies.predecessors(edges, nodes.where("kind = 'dataset'"))


@query("direct_dependencies", f"WITH {GRAPH} SELECT DISTINCT source AS node, target AS neighbour FROM g WHERE source LIKE 'feature:%' AND kind = 'dataset'")
def direct_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = graph(spark, sf_dir)
    return dependencies.successors(edges, nodes.where("kind = 'feature'"), ["dataset"])


@query("subgraph", f"WITH {GRAPH} SELECT source, target, kind FROM g WHERE (source LIKE 'dataset:%' OR source LIKE 'file:%' OR source LIKE 'region:%') AND (target LIKE 'dataset:%' OR target LIKE 'file:%' OR target LIKE 'region:%')")
def subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = graph(spark, sf_dir)
    return dependencies.subgraph(edges, nodes.where("kind IN ('dataset', 'file', 'region')")).select("source", "target", "kind")


@query("validation_plan", f"""WITH RECURSIVE {GRAPH}, {NODES}, {DOWN} SELECT kind, CASE kind WHEN 'dataset' THEN 'data_quality_and_schema' WHEN 'feature' THEN 'feature_recompute_and_distribution' WHEN 'model' THEN 'model_regression_and_slices' WHEN 'file' THEN 'import_and_integration_smoke' ELSE 'smoke_and_regression_tests' END AS "check",
CASE WHEN kind IN ('dataset', 'feature', 'model') THEN 'high' WHEN kind = 'file' THEN 'medium' ELSE 'low' END AS priority, count(*) AS affected, min(id) AS first_id FROM a JOIN n USING (id) GROUP BY kind""")
def validation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependencies.recommendations(affected(spark, sf_dir), graph(spark, sf_dir)[1]).withColumn("first_id", F.col("first_ids")[0]).drop("first_ids")


@query("skipped_models", f"WITH RECURSIVE {GRAPH}, {NODES}, {DOWN} SELECT id FROM n ANTI JOIN a USING (id) WHERE kind = 'model'")
def skipped_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependencies.skipped(graph(spark, sf_dir)[1], affected(spark, sf_dir))


@query("graph_union", "SELECT user_id, arg_max(event_type, event_id) AS kind, arg_max(CASE WHEN event_id % 3 = 0 THEN props END, event_id) FILTER (WHERE event_id % 3 = 0) AS props FROM events GROUP BY user_id")
def graph_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("kind"), F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("props"), "event_id")
    return dependencies.unite(e, ["user_id"], "event_id")


@query("line_range_join", """WITH f AS (SELECT p_partkey AS id, p_brand AS path, p_size AS a, p_size + 2 AS b FROM part WHERE p_partkey % 3 <> 0), w AS (SELECT DISTINCT p_brand AS path FROM part),
c AS (SELECT DISTINCT p_brand AS path, l_linenumber * 6 AS line FROM lineitem JOIN part ON l_partkey = p_partkey),
h AS (SELECT DISTINCT 'function:' || id AS id, c.path FROM c JOIN f ON f.path = c.path AND line BETWEEN a AND b)
SELECT DISTINCT id, 'range' AS matched_by FROM h UNION ALL SELECT 'file:' || path, 'path' FROM w WHERE path IN (SELECT path FROM c) AND path NOT IN (SELECT path FROM h)""")
def line_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    size = F.col("p_size")
    functions = part.where("p_partkey % 3 <> 0").select(F.concat(F.lit("function:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("function").alias("kind"), F.col("p_brand").alias("path"), size.alias("line_from"), (size + 2).alias("line_to"))
    none = F.lit(None).cast("int")
    files = part.select("p_brand").distinct().select(F.concat(F.lit("file:"), F.col("p_brand")).alias("id"), F.lit("file").alias("kind"), F.col("p_brand").alias("path"), none.alias("line_from"), none.alias("line_to"))
    changes = li.join(part, li.l_partkey == part.p_partkey).select(F.col("p_brand").alias("path"), (F.col("l_linenumber") * 6).alias("line"))
    return dependencies.changed_nodes(changes, functions.unionByName(files))


@query("held_items", "SELECT c_custkey FROM customer WHERE c_mktsegment || '/' || c_nationkey = 'BUILDING/3' OR c_mktsegment = 'MACHINERY'")
def held_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string"))
    items = table(spark, sf_dir, "customer").select("c_custkey", path.alias("path"))
    holds = spark.createDataFrame([("BUILDING/3",), ("MACHINERY",), ("MACH",)], "path string")
    return dependencies.held_by_prefix(items, holds).select("c_custkey")


@query("retention_plan", """WITH i AS (SELECT o_custkey AS owner, o_orderkey AS path, o_totalprice AS size, epoch(o_orderdate)::DOUBLE AS mtime FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY mtime DESC, path DESC) <= 2 AS safe FROM i),
o AS (SELECT *, NOT safe AND 1e9 - mtime > 1e8 AS old FROM r),
b AS (SELECT *, sum(CASE WHEN NOT old THEN size ELSE 0 END) OVER (PARTITION BY owner) AS total, coalesce(sum(CASE WHEN NOT old AND NOT safe THEN size ELSE 0 END) OVER (PARTITION BY owner ORDER BY mtime, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
SELECT owner, path, CASE WHEN old THEN 'age' ELSE 'budget' END AS reason FROM b WHERE old OR (NOT safe AND total - before > 500000.0)""")
def retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("o_orderdate")).cast("double")
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("size"), seconds.alias("mtime"))
    return operations.retention_plan(items, ["owner"], 1e9, 1e8, 500_000.0, keep_recent=2)


@query("queue_blocked", "WITH q AS (SELECT event_id, event_type = 'error' AND event_id % 4 = 0 AS f, max((event_type = 'error' AND event_id % 4 = 0)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) SELECT event_id, CASE WHEN b = 1 THEN 'blocked' WHEN f THEN 'failed' ELSE 'applied' END AS state FROM q")
def queue_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = table(spark, sf_dir, "events").withColumn("fails", (F.col("event_type") == "error") & (F.col("event_id") % 4 == 0))
    return operations.flush_queue(ops, "user_id", ["event_id"], "fails").select("event_id", "state")


def day_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as revisions and users as runs; from the 20th on all fail, on the 5th and 25th they differ."""
    day = F.dayofmonth("ts")
    passed = F.when(day.isin(5, 25), F.col("user_id") % 2 == 0).otherwise(day < 20)
    return table(spark, sf_dir, "events").select(day.alias("rev_idx"), passed.alias("passed"))


VOTES = "v AS (SELECT day(ts)::INT AS rev_idx, CASE WHEN day(ts) IN (5, 25) THEN user_id % 2 = 0 ELSE day(ts) < 20 END AS p FROM events), s AS (SELECT rev_idx, count(*) AS runs, count(*) FILTER (WHERE p) AS passes, count(*) FILTER (WHERE NOT p) AS fails, CASE WHEN count(*) FILTER (WHERE p) = count(*) THEN 'good' WHEN count(*) FILTER (WHERE NOT p) = count(*) THEN 'bad' ELSE 'inconclusive' END AS status FROM v GROUP BY 1)"


@query("bisect_votes", f"WITH {VOTES} SELECT * FROM s")
def bisect_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bisection.votes(day_votes(spark, sf_dir))


@query("bisect_first_bad", f"WITH {VOTES}, f AS (SELECT min(rev_idx) AS b FROM s WHERE status = 'bad'), a AS (SELECT b AS first_seen_bad, (SELECT count(*) FROM s WHERE status = 'good' AND rev_idx > b) AS good_after_bad, (SELECT count(*) FROM s WHERE status = 'inconclusive' AND rev_idx < b) AS inconclusive_before, (SELECT max(rev_idx) FROM s WHERE status = 'good' AND rev_idx < b) AS last_good FROM f) SELECT CASE WHEN good_after_bad = 0 AND inconclusive_before = 0 THEN first_seen_bad END AS first_bad, * FROM a")
def bisect_first_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bisection.monotonicity(bisection.votes(day_votes(spark, sf_dir)))


@query("bisect_nonmonotonic", f"WITH {VOTES} SELECT rev_idx, status FROM s WHERE rev_idx >= (SELECT min(rev_idx) FROM s WHERE status = 'bad') AND status <> 'good'")
def bisect_nonmonotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bisection.candidates(bisection.votes(day_votes(spark, sf_dir)))


@query("bisect_scores", f"""WITH c AS (SELECT day(ts)::INT AS rev_idx, user_id AS seed, avg(value) AS score FROM events GROUP BY 1, 2), p AS (SELECT c.rev_idx, c.seed, c.score - b.score AS difference FROM c JOIN c b ON b.seed = c.seed AND b.rev_idx = 1 WHERE c.rev_idx > 1),
{resamples_sql('p', 'rev_idx', 'difference', 'seed', 60, 5)}, b AS (SELECT rev_idx, quantile_cont(s, 0.025) AS lower, quantile_cont(s, 0.975) AS upper FROM s GROUP BY 1), n AS (SELECT rev_idx, count(*) AS n, avg(difference) AS estimate FROM p GROUP BY 1)
SELECT rev_idx, n, estimate, lower, upper, CASE WHEN n < 5 THEN 'inconclusive' WHEN upper < -2.0 THEN 'bad' WHEN lower >= -2.0 THEN 'good' ELSE 'inconclusive' END AS status FROM b JOIN n USING (rev_idx)""")
def bisect_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy(F.dayofmonth("ts").alias("rev_idx"), F.col("user_id").alias("seed")).agg(F.avg("value").alias("score"))
    return bisection.classify(s.where("rev_idx > 1"), s.where("rev_idx = 1"), tolerance=2.0, resamples=60, seed=5).drop("p_value")


@query("bisect_uncomputed", "SELECT DISTINCT user_id, day(ts)::INT AS rev_idx FROM events ANTI JOIN (SELECT DISTINCT user_id, day(ts)::INT AS d FROM events WHERE event_id % 3 = 0) k ON k.user_id = events.user_id AND k.d = day(ts)")
def bisect_uncomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "events").select("user_id", F.dayofmonth("ts").alias("rev_idx"), "event_id")
    return bisection.uncomputed(cells.select("user_id", "rev_idx").distinct(), cells.where("event_id % 3 = 0"), ["user_id", "rev_idx"])


def _sql_pattern(pattern: str) -> str:
    return pattern.replace("'", "''")


FINDINGS = " UNION ALL ".join(f"SELECT doc_id AS id, '{name}' AS kind, len(regexp_extract_all(text, '{_sql_pattern(p)}')) AS findings FROM documents" for name, p, _ in SECRET_PATTERNS)


@query("sensitive_findings", f"SELECT id, kind, findings FROM ({FINDINGS}) WHERE findings > 0")
def sensitive_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), "doc_id", "text")


def _redacted_sql(column: str) -> str:
    for _, pattern, kept in SECRET_PATTERNS:
        column = f"regexp_replace({column}, '{_sql_pattern(pattern)}', '{kept.replace('$', chr(92))}', 'g')"
    return column


@query("redacted_text", f"SELECT doc_id, sha256({_redacted_sql('text')}) AS redacted_sha256, {_redacted_sql('text')} <> text AS changed FROM documents")
def redacted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    safe = redact_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(safe, 256).alias("redacted_sha256"), (safe != F.col("text")).alias("changed"))


@query("failure_groups", r"""WITH m AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'a.' WHEN event_id % 3 = 1 THEN 'builtins.' ELSE '' END || event_type AS t, 'step ' || user_id || ' of ' || event_type || ' failed:  0x1f token=' || event_id || ' after ' || round(value, 2) || 's' AS m FROM events),
n AS (SELECT CASE WHEN starts_with(t, 'builtins.') THEN substr(t, 10) ELSE t END AS error_type, regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '(?i)\b(password|passwd|secret|token|api[_-]?key)\s*[:=]\s*[^\s,;]+', '\1=<redacted>', 'g'), '(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b', '<uuid>', 'g'), '\b(0x[0-9a-fA-F]+|\d+(\.\d+)?)\b', '<number>', 'g'), '\s+', ' ', 'g') AS message FROM m)
SELECT error_type, trim(message) AS message, count(*) AS failures FROM n GROUP BY 1, 2""")
def failure_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat(F.lit("step "), F.col("user_id").cast("string"), F.lit(" of "), "event_type", F.lit(" failed:  0x1f token="), F.col("event_id").cast("string"), F.lit(" after "), F.round("value", 2).cast("string"), F.lit("s"))
    module = F.when(F.col("event_id") % 3 == 0, "a.").when(F.col("event_id") % 3 == 1, "builtins.").otherwise("")
    raised = table(spark, sf_dir, "events").select(F.lit("exception").alias("kind"), F.concat(module, F.col("event_type")).alias("error_type"), message.alias("message"))
    return failures.groups(raised).select("error_type", F.col("normalized_message").alias("message"), "failures")


@query("parity_words", "SELECT event_type, CASE WHEN event_id % 3 = 0 THEN event_id % 2 = 0 WHEN event_type = 'error' THEN false WHEN event_type = 'view' THEN true END AS passed, count(*) AS n FROM events GROUP BY 1, 2")
def parity_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 2 == 0)
    status = F.when(F.col("event_type") == "view", "Passed").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").groupBy("event_type", parity_passed(flag, status).alias("passed")).agg(F.count(F.lit(1)).alias("n"))


@query("generated_inputs", "SELECT id, i, CAST('0x' || substr(md5('11:' || id || ':' || i), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0 * 4.0 - 2.0 AS x FROM range(3, 40) AS a(id), range(1, 6) AS b(i)")
def generated_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = inputs.representative(spark, 5, 40, seed=11, low=-2.0, high=2.0)
    rows = cases.select(F.substring_index("case_id", "-", -1).cast("long").alias("id"), F.posexplode("values").alias("p", "x"))
    return rows.where("id >= 3").select("id", (F.col("p") + 1).cast("long").alias("i"), "x")


def sql_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One SQL statement per part, whose tables are its brand and type."""
    name = lambda c: F.regexp_replace(F.lower(F.col(c)), "[^a-z0-9]+", "_")
    text = F.concat(F.lit("-- from hidden\nINSERT INTO out_"), name("p_brand"), F.lit(" WITH c AS (SELECT 1) SELECT * FROM c, in_"), name("p_type"), F.lit(" JOIN '"), name("p_brand"), F.lit(".parquet' ON true"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), text.alias("text"))


_N = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g')"


@query("sql_lineage", f"SELECT p_partkey::VARCHAR AS id, 'out_' || {_N('p_brand')} AS name, 'writes' AS relation, false AS dynamic FROM part UNION ALL SELECT p_partkey::VARCHAR, 'in_' || {_N('p_type')}, 'reads', false FROM part UNION ALL SELECT p_partkey::VARCHAR, {_N('p_brand')} || '.parquet', 'reads', false FROM part")
def sql_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.read_sql(sql_texts(spark, sf_dir), "id", "text")


@query("openlineage_edges", "WITH e AS (SELECT DISTINCT 'default/job' || (c_custkey % 50) AS job, 'default/in' || c_nationkey AS i, 'default/out' || c_mktsegment AS o FROM customer) SELECT DISTINCT job AS source, i AS target, 'reads' AS kind FROM e UNION ALL SELECT DISTINCT o, job, 'produced_by' FROM e")
def openlineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda prefix, c: F.array(F.struct(F.concat(F.lit(prefix), F.col(c).cast("string")).alias("name")))
    event = F.to_json(F.struct(F.struct(F.concat(F.lit("job"), (F.col("c_custkey") % 50).cast("string")).alias("name")).alias("job"), one("in", "c_nationkey").alias("inputs"), one("out", "c_mktsegment").alias("outputs")))
    lines = table(spark, sf_dir, "customer").select(event.alias("value"))
    return lineage.read_openlineage(lines.unionByName(spark.createDataFrame([("not json",), ("{}",)], "value string")))


@query("lineage_events", "WITH j AS (SELECT DISTINCT 'nation:' || n_nationkey AS job FROM nation) SELECT job, 0 AS part, ['region:' || n_regionkey] AS inputs, coalesce((SELECT list(DISTINCT 'supplier:' || s_suppkey ORDER BY 'supplier:' || s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), []) AS outputs FROM j JOIN nation ON job = 'nation:' || n_nationkey")
def lineage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    edges = nation.select(name("nation", "n_nationkey").alias("source"), name("region", "n_regionkey").alias("target")).unionByName(supplier.select(name("supplier", "s_suppkey").alias("source"), name("nation", "s_nationkey").alias("target")))
    return dependencies.lineage_events(edges, nation.select(name("nation", "n_nationkey").alias("id"), F.lit("job").alias("kind")))


@query("diff_lines", "WITH k AS (SELECT p_partkey AS id, p_brand AS path, p_size AS s FROM part) SELECT id, path, 'removed' AS side, (s + 1)::BIGINT AS line FROM k UNION ALL SELECT id, path, 'added', (s + 1)::BIGINT FROM k UNION ALL SELECT id, path, 'added', (s + 2)::BIGINT FROM k")
def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size").cast("string")
    diff = [F.concat(F.lit("--- a/"), "p_brand"), F.concat(F.lit("+++ b/"), "p_brand"), F.concat(F.lit("@@ -"), s, F.lit(",3 +"), s, F.lit(",4 @@ f()")), F.lit(" same"), F.lit("-old"), F.lit("+new"), F.lit("+newer"), F.lit(" tail")]
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.posexplode(F.array(*diff)).alias("place", "line"))
    return lineage.parse_diff(lines, ["id"])


@query("ddmin_rows", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 50 AND l_linenumber = 4 AND l_returnflag = 'R' QUALIFY row_number() OVER (ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC) = 1")
def ddmin_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all lines a smallest table that still fails: it fails with any line that is its order's fourth, has a quantity of 50
    and came back, and the shrinker, which leaves out what it can from the front, keeps the last such line."""
    rows = numbered(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag"), ["l_orderkey", "l_linenumber", "l_partkey"])
    return minimise.shrink_rows(rows, lambda df: not df.where("l_quantity = 50 AND l_linenumber = 4 AND l_returnflag = 'R'").isEmpty()).select("l_orderkey", "l_linenumber")
