"""Evidence in metadata and artifacts, impact plans and pipeline files over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import impact, lineage, pairing, records
from .registry import query, table

RUNS = """r AS (SELECT event_id AS run_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS trial, CASE WHEN event_id % 3 = 0 THEN event_id % 7 END AS seed, CASE WHEN event_id % 3 = 1 THEN event_id % 11 END AS cseed, CASE WHEN event_id % 4 = 0 THEN event_id % 13 END AS pseed, event_type, value, event_id FROM events),
i AS (SELECT *, coalesce(seed, cseed, pseed) AS s FROM r)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a run, with a trial, and a seed in one of several places or none."""
    i = F.col("event_id")
    metadata = F.to_json(F.struct(F.when(i % 5 != 0, F.col("user_id")).alias("trial"), F.when(i % 3 == 0, i % 7).alias("seed"), F.when(i % 3 == 1, F.struct((i % 11).alias("seed"))).alias("configuration")))
    plan = F.when(i % 4 == 0, F.to_json(F.struct((i % 13).alias("seed"))))
    return table(spark, sf_dir, "events").select(i.alias("run_id"), metadata.alias("metadata"), plan.alias("replay_plan"), "event_type", "value", "event_id")


IDENTITY = "CASE WHEN s IS NULL AND trial IS NULL THEN NULL ELSE '{' || concat_ws(',', CASE WHEN s IS NOT NULL THEN '\"seed\":\"' || s || '\"' END, CASE WHEN trial IS NOT NULL THEN '\"trial\":\"' || trial || '\"' END) || '}' END AS identity"


@query("run_identity", f"WITH {RUNS} SELECT run_id, {IDENTITY}, s IS NOT NULL OR trial IS NOT NULL AS pairable FROM i")
def run_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.declared_identity(runs(spark, sf_dir)).select("run_id", "identity", "pairable")


@query("member_pairs", f"WITH {RUNS}, k AS (SELECT run_id, run_id % 2 AS side, {IDENTITY} FROM i), p AS (SELECT *, row_number() OVER (PARTITION BY side, identity ORDER BY run_id) AS place FROM k WHERE identity IS NOT NULL) SELECT b.run_id AS baseline_run, c.run_id AS candidate_run FROM p b JOIN p c ON b.side = 0 AND c.side = 1 AND b.identity = c.identity AND b.place = c.place")
def member_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = records.declared_identity(runs(spark, sf_dir))
    return records.pair_members(known.where("run_id % 2 = 0"), known.where("run_id % 2 = 1"))


@query("run_configuration", """SELECT event_id AS run_id, CASE event_id % 4 WHEN 0 THEN '{"lr":' || user_id || '}' WHEN 1 THEN '{"depth":' || event_id || '}' ELSE '{}' END AS configuration FROM events""")
def run_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    metadata = F.to_json(F.struct(F.when(i % 4 == 0, F.struct(F.col("user_id").alias("lr"))).alias("config"), F.when(i % 2 == 0, F.lit("text")).alias("configuration"), F.when(i % 4 == 1, F.struct(i.alias("depth"))).alias("hyperparameters")))
    return table(spark, sf_dir, "events").select(i.alias("run_id"), metadata.alias("metadata")).select("run_id", records.configuration().alias("configuration"))


def parity_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(runs, artifacts): some runs have a result in their metadata, some in a file, some in a broken file."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events")
    metadata = F.to_json(F.struct(F.when(i % 3 == 0, F.struct((i % 2 == 0).alias("passed"))).alias("parity"), F.when(i % 6 == 1, F.lit("passed")).alias("parity_result")))
    content = F.when(i % 4 == 2, F.lit('{"status": "failed"}')).otherwise(F.lit("not json"))
    files = e.where("event_id % 2 = 0").select(i.alias("run_id"), F.concat(F.lit("out/Parity"), F.when(i % 5 == 0, "_Result").otherwise(""), F.lit(".json")).alias("name"), F.lit("00").alias("sha256"), content.alias("content"))
    return e.select(i.alias("run_id"), metadata.alias("metadata")), files


@query("parity_members", "SELECT event_id AS run_id, CASE WHEN event_id % 3 = 0 THEN event_id % 2 = 0 WHEN event_id % 6 = 1 THEN true WHEN event_id % 4 = 2 THEN false END AS parity FROM events WHERE event_id % 3 = 0 OR event_id % 6 = 1 OR event_id % 4 = 2")
def parity_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, files = parity_runs(spark, sf_dir)
    return records.member_parity(made, records.parity_evidence(made, files))


@query("behaviour_source", """SELECT event_id AS run_id, CASE WHEN event_id % 3 = 0 THEN '{"n":' || user_id || '}' WHEN event_id % 3 = 1 THEN '{"predictions":"[1,2]","labels":"[' || event_id || ']"}' WHEN event_id % 2 = 0 THEN '{"from":"file"}' END AS behaviour FROM events""")
def behaviour_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    e = table(spark, sf_dir, "events")
    metadata = F.to_json(F.struct(F.when(i % 3 == 0, F.struct(F.col("user_id").alias("n"))).alias("behavioral_evidence"), F.when(i % 3 != 2, F.array(F.lit(1), F.lit(2))).alias("predictions"), F.array(i).alias("labels")))
    files = e.where("event_id % 2 = 0").select(i.alias("run_id"), F.lit("predictions.json").alias("name"), F.lit("00").alias("sha256"), F.lit('{"from":"file"}').alias("content"))
    return records.behaviour_evidence(e.select(i.alias("run_id"), metadata.alias("metadata")), files)


@query("resource_samples", """WITH v AS (SELECT event_type AS name, user_id, CASE WHEN event_type = 'view' AND event_id % 1000 = 0 THEN NULL ELSE event_id::VARCHAR END AS identity, CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS value FROM events)
SELECT name, user_id, CASE WHEN bool_and(identity IS NOT NULL) OVER (PARTITION BY name, user_id) THEN identity END AS identity, value FROM v WHERE value IS NOT NULL""")
def resource_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "user_id", "event_id", F.when(~((F.col("event_type") == "view") & (i % 1000 == 0)), i.cast("string")).alias("identity"), F.when(i % 97 == 0, float("nan")).otherwise(F.col("value")).alias("value"))
    return records.resource_samples(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["name", "user_id"])


@query("observation_names", "SELECT DISTINCT event_type || user_id % 10 AS name FROM events WHERE event_id % 3 <> 1")
def observation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    kind = F.when(i % 3 == 0, "metric").when(i % 3 == 1, "resource")
    o = table(spark, sf_dir, "events").select(F.concat(F.col("event_type"), (F.col("user_id") % 10).cast("string")).alias("name"), kind.alias("kind"))
    return records.observation_names(o, "metric")


@query("dataset_fingerprints", "SELECT p_brand AS name, p_type AS split, 'csv' AS format, CASE WHEN p_partkey % 2 = 0 THEN 'a' || p_partkey ELSE 'm' || p_partkey END AS sha256, CASE WHEN p_partkey % 3 = 0 THEN 'file:' || p_partkey END AS uri, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size::BIGINT END AS sample_count FROM part")
def dataset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = k.cast("string")
    artifact = F.to_json(F.struct(F.when(k % 2 == 0, F.concat(F.lit("a"), text)).alias("sha256"), F.when(k % 3 == 0, F.concat(F.lit("file:"), text)).alias("uri")))
    metadata = F.to_json(F.struct(F.concat(F.lit("m"), text).alias("sha256"), F.when(k % 5 != 0, F.col("p_size")).alias("row_count")))
    d = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("split"), F.lit("csv").alias("format"), artifact.alias("artifact"), metadata.alias("metadata"))
    return records.dataset_fingerprints(d)


@query("live_payloads", "SELECT event_id, sha256(event_id::VARCHAR) AS sha256 FROM events WHERE event_id % 3 = 0 OR (event_id % 2 = 0 AND event_id % 5 <> 0)")
def live_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("sha256"))
    artifacts = e.where("event_id % 2 = 0").select("sha256", F.when(F.col("event_id") % 5 == 0, "replay_state").alias("role"))
    evidence = e.where("event_id % 3 = 0").select(F.concat(F.lit('{"ref": "'), "sha256", F.lit('"}')).alias("json"))
    return records.referenced_payloads(e, artifacts, evidence)


@query("slice_examples", "SELECT event_type, list_sort(list(event_id)) [1:5] AS examples FROM events GROUP BY 1")
def slice_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.slice_examples(table(spark, sf_dir, "events"), ["event_type"], "event_id", 5)


def code_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a file per brand that contains a function per part; customers' segments are models that need
    brands by their number, and nations datasets."""
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    none, text = F.lit(None), lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    path = F.concat(F.lit("src/"), F.regexp_replace("p_brand", "#", "_"), F.lit(".py"))
    brand = part.select("p_brand", path.alias("path")).distinct()
    files = brand.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("kind"), "path", none.cast("int").alias("line_from"), none.cast("int").alias("line_to"))
    functions = part.select(text("function", "p_partkey").alias("id"), F.lit("function").alias("kind"), path.alias("path"), F.col("p_size").alias("line_from"), (F.col("p_size") + 1).alias("line_to"))
    models = customer.select(text("model", "c_custkey").alias("id"), F.lit("model").alias("kind"), none.cast("string").alias("path"), none.cast("int").alias("line_from"), none.cast("int").alias("line_to"))
    nodes = files.unionByName(functions).unionByName(models).withColumn("name", F.regexp_replace("id", "^[^:]*:", ""))
    contains = part.select(F.concat(F.lit("file:"), path).alias("source"), text("function", "p_partkey").alias("target"), F.lit("contains").alias("kind"))
    uses = customer.join(part, F.col("c_custkey") == F.col("p_partkey")).select(text("model", "c_custkey").alias("source"), text("function", "p_partkey").alias("target"), F.lit("calls").alias("kind"))
    return nodes, contains.unionByName(uses)


CODE = """p AS (SELECT p_partkey, 'src/' || replace(p_brand, '#', '_') || '.py' AS path, p_size FROM part), few AS (SELECT path FROM p GROUP BY path ORDER BY path LIMIT 3),
ch AS (SELECT path, CASE WHEN path = (SELECT min(path) FROM few) THEN NULL ELSE 10 END AS line FROM few),
fn AS (SELECT 'function:' || p_partkey AS id, p.path, p_partkey FROM p JOIN ch ON ch.path = p.path AND (line BETWEEN p_size AND p_size + 1 OR line IS NULL)),
fl AS (SELECT 'file:' || path AS id, path FROM ch WHERE line IS NULL OR path NOT IN (SELECT path FROM fn)),
inside AS (SELECT 'function:' || p_partkey AS id, p_partkey FROM p JOIN fl USING (path)),
ro AS (SELECT id, p_partkey FROM fn UNION SELECT id, p_partkey FROM inside UNION SELECT id, NULL FROM fl)"""


def code_changes(nodes: DataFrame) -> DataFrame:
    """The first three files: the first wholly changed, of the others line 10."""
    first = nodes.where("kind = 'file'").orderBy("path").limit(3)
    least = first.agg(F.min("path").alias("least"))
    return first.join(F.broadcast(least), F.lit(True)).select(F.regexp_replace("path", "^src/", "./").alias("path"), F.when(F.col("path") != F.col("least"), 10).alias("line"))


@query("change_roots", f"WITH {CODE} SELECT DISTINCT id FROM ro")
def change_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = code_graph(spark, sf_dir)
    return impact.roots(code_changes(nodes), nodes, edges)[0].select("id").distinct()


@query("impact_plan", f"WITH {CODE}, m AS (SELECT DISTINCT 'model:' || c_custkey AS id FROM customer JOIN ro ON p_partkey = c_custkey), o AS (SELECT DISTINCT 'file:' || path AS id FROM p JOIN ro USING (p_partkey)) SELECT id, 0 AS distance FROM ro GROUP BY id UNION ALL SELECT id, 1 FROM (SELECT id FROM m UNION SELECT id FROM o) WHERE id NOT IN (SELECT id FROM ro)")
def impact_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = code_graph(spark, sf_dir)
    return impact.plan(code_changes(nodes), nodes, edges)


@query("impact_report", f"""WITH {CODE}, m AS (SELECT DISTINCT c_custkey::VARCHAR AS name FROM customer JOIN ro ON p_partkey = c_custkey)
SELECT 'target' AS part, name FROM m UNION ALL SELECT 'validation', v FROM (VALUES ('focused_unit_tests'), ('import_and_integration_smoke'), ('py_tests')) AS x(v) UNION ALL SELECT 'validation', 'model_regression_and_slices' WHERE EXISTS (SELECT 1 FROM m) UNION ALL SELECT 'skipped', 'never' UNION ALL SELECT 'target', 'always'""")
def impact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = code_graph(spark, sf_dir)
    mappings = {"models": {"always": [".py"], "never": {"depends_on": ["no/such"]}}, "validations": {"py_tests": "*.py", "sql_tests": ["*.sql"]}}
    found = impact.report(code_changes(nodes), nodes, edges, mappings)
    named = {"target": found["targets"], "validation": found["validations"], "skipped": found["skipped"]}
    out = None
    for part, rows in named.items():
        own = rows.select(F.lit(part).alias("part"), "name")
        out = own if out is None else out.unionByName(own)
    return out


@query("relationship_edges", "SELECT * FROM (VALUES ('feature:f', 'dataset:d', 'configured'), ('feature:f', 'file:f.py', 'implemented_by'), ('feature:g', 'dataset:d', 'configured'), ('model:m', 'feature:f', 'configured'), ('model:m', 'feature:g', 'configured'), ('model:n', 'feature:f', 'derived'), ('feature:h', 'dataset:e', 'configured')) AS x(source, target, kind)")
def relationship_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = {
        "datasets": {"d": {"path": None}, "e": {"produces": "h"}},
        "features": [{"name": "f", "implemented_by": "f.py", "inputs": ["d"]}, {"name": "g", "datasets": {"name": "d"}}, "broken"],
        "models": {"m": ["f", "feature:g"], "n": {}},
        "relationships": [{"source": "n", "target": "f", "kind": "derived"}, {"source": "n"}, 7],
    }
    return impact.relationships(spark, config)[1]


@query("graph_load", "SELECT DISTINCT 'c' || c_custkey % 100 AS source, 'n' || c_nationkey AS target, 'depends_on' AS kind FROM customer")
def graph_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = F.concat(F.lit("c"), (F.col("c_custkey") % 100).cast("string")), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    graph = F.to_json(F.struct(F.array(F.struct(source.alias("node_id"))).alias("nodes"), F.array(F.struct(source.alias("source"), target.alias("target")), F.struct(source.alias("source"), F.lit(None).cast("string").alias("target"))).alias("edges")))
    return impact.load_graph(table(spark, sf_dir, "customer").select(graph.alias("value")))[1]


@query("dvc_stages", "SELECT n_name AS stage, 'run ' || n_nationkey AS cmd, ['r/' || n_regionkey] AS deps, coalesce((SELECT list(DISTINCT 's/' || s_suppkey ORDER BY 's/' || s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), []) AS outs FROM nation")
def dvc_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region, supplier = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    stages = nation.select(text("stage:", "n_nationkey").alias("id"), F.lit("stage").alias("kind"), F.col("n_name").alias("name"), none.alias("path"), F.to_json(F.struct(text("run ", "n_nationkey").alias("cmd"))).alias("metadata"))
    data = lambda df, p, c: df.select(text(f"{p}:", c).alias("id"), F.lit("dataset").alias("kind"), none.alias("name"), text(f"{p}/", c).alias("path"), none.alias("metadata"))
    declared = nation.select(F.lit("dvc.yaml").alias("id"), F.lit("dvc").alias("kind"), none.alias("name"), F.lit("dvc.yaml").alias("path"), none.alias("metadata")).limit(1)
    nodes = stages.unionByName(data(region, "r", "r_regionkey")).unionByName(data(supplier, "s", "s_suppkey")).unionByName(declared)
    edges = nation.select(text("stage:", "n_nationkey").alias("source"), text("r:", "n_regionkey").alias("target")).unionByName(supplier.select(text("s:", "s_suppkey").alias("source"), text("stage:", "s_nationkey").alias("target"))).unionByName(nation.select(F.lit("dvc.yaml").alias("source"), text("stage:", "n_nationkey").alias("target")))
    return impact.dvc_stages(nodes, edges)


@query("diff_impact", "SELECT p_partkey AS id, 'function:' || p_partkey AS node FROM part WHERE p_partkey % 3 <> 0")
def diff_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff per part that adds line 7 of its own file, and the function there that the line lies in."""
    part = table(spark, sf_dir, "part")
    path = F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.lit(".py"))
    diff = [F.concat(F.lit("--- a/"), path), F.concat(F.lit("+++ b/"), path), F.lit("@@ -6,1 +6,2 @@"), F.lit(" same"), F.lit("+new")]
    lines = part.select(F.col("p_partkey").alias("id"), F.posexplode(F.array(*diff)).alias("place", "line"))
    changes = lineage.parse_diff(lines, ["id"]).where("side = 'added'").select("path", F.col("line").cast("int").alias("line"))
    last = F.when(F.col("p_partkey") % 3 == 0, 6).otherwise(7)  # every third function ends before the line
    nodes = part.select(F.concat(F.lit("function:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("function").alias("kind"), path.alias("path"), F.lit(5).alias("line_from"), last.alias("line_to"))
    edges = part.select(F.lit("x").alias("source"), F.lit("y").alias("target"), F.lit("calls").alias("kind")).limit(0)
    found = impact.roots(changes, nodes, edges)[0].where("matched_by = 'range'")
    return found.select(F.regexp_extract("id", r"(\d+)$", 1).cast("long").alias("id"), F.col("id").alias("node"))


@query("metric_names", "SELECT DISTINCT event_type AS name FROM events UNION SELECT 'required_one'")
def metric_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "name")
    return pairing.names_of(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), required=["required_one"])
