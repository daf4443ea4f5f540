"""Features computed in several ways, seeded runs, trace analysis, stores, indexes and capsules over the test tables."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import shared_folder
from ..operators import adapters, groups, resources, trace
from ..sources import capsules, files, index, store
from .operations import TRACE, trace_events
from .registry import query, table


def _own_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/runlens-{name}-{uuid.uuid4().hex}"


def _by_row(r: dict[str, Any]) -> dict[str, Any]:
    return {"double_size": r["p_size"] * 2, "many": r["p_size"] >= 25}


def _by_batch(pdf: Any) -> Any:
    out = pdf[["row_idx"]].copy()
    out["double_size"] = pdf["p_size"] * 2
    out["many"] = pdf["p_size"] > 25
    return out


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_idx"), F.col("p_size").cast("long").alias("p_size"))


@query("feature_ways", "SELECT p_partkey AS row_idx, 'many' AS \"column\", 'value' AS kind FROM part WHERE p_size = 25")
def feature_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pandas feature that has > where SQL has >=: the parts at the border differ."""
    sql = lambda df: adapters.sql_features(df, "SELECT row_idx, p_size * 2 AS double_size, p_size >= :least AS many FROM feature_parts", "feature_parts", {"least": 25})
    batch = lambda df: adapters.batch_features(df, _by_batch, "row_idx bigint, double_size bigint, many boolean")
    return adapters.feature_parity(parts(spark, sf_dir), sql, batch).select("row_idx", "column", "kind")


@query("row_features", "SELECT p_partkey AS row_idx, p_size::BIGINT * 2 AS double_size, p_size >= 25 AS many FROM part")
def row_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.row_features(parts(spark, sf_dir), _by_row, "double_size bigint, many boolean", ["row_idx"])


def _judged(seed: int, bad: int) -> int:
    if seed % bad == 0:
        raise ValueError(f"seed {seed} is bad")
    return seed * seed


@query("seeded_runs", "SELECT n AS seed, CASE WHEN n % 4 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN n % 4 <> 0 THEN (n * n)::VARCHAR END AS value, CASE WHEN n % 4 = 0 THEN 'ValueError: seed ' || n || ' is bad' END AS error FROM (SELECT n_nationkey::BIGINT AS n FROM nation)")
def seeded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = [r.n for r in table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey AS long) AS n").collect()]  # the 25 nations
    return adapters.run_seeds(spark, _judged, seeds, {"bad": 4})


@query("trace_analysis", f"""WITH RECURSIVE {TRACE}, k AS (SELECT e.user_id, e.event_id, e.ts, e.abnormal, e.parent FROM e WHERE event_id % 7 <> 0 AND event_id >= 100),
s AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS node FROM k WHERE abnormal GROUP BY user_id),
a AS (SELECT user_id, node, 0 AS depth FROM s UNION ALL SELECT a.user_id, e.parent, a.depth + 1 FROM a JOIN e ON e.user_id = a.user_id AND e.event_id = a.node WHERE e.parent IS NOT NULL),
ro AS (SELECT a.user_id, a.node FROM a JOIN e ON e.user_id = a.user_id AND e.event_id = a.node WHERE e.parent IS NULL),
m AS (SELECT DISTINCT a.user_id, e.parent AS node FROM a JOIN e ON e.user_id = a.user_id AND e.event_id = a.node WHERE e.parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = a.user_id AND k.event_id = e.parent)),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM k), w AS (SELECT *, min(i) FILTER (WHERE abnormal) OVER (PARTITION BY user_id) AS z FROM p)
SELECT user_id, node::VARCHAR AS node, 'ancestor' AS part, depth::VARCHAR AS detail FROM a UNION ALL SELECT user_id, node::VARCHAR, 'root', NULL FROM ro
UNION ALL SELECT user_id, node::VARCHAR, 'missing', CASE WHEN node < 100 AND EXISTS (SELECT 1 FROM k WHERE k.user_id = m.user_id) THEN 'evicted' ELSE 'never_recorded' END FROM m UNION ALL SELECT user_id, event_id::VARCHAR, 'window', (i - z)::VARCHAR FROM w WHERE abs(i - z) <= 2""")
def trace_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ring holds events from 100 on, other than every seventh."""
    e = trace_events(spark, sf_dir)
    held = e.where("event_id % 7 <> 0 AND event_id >= 100").select("user_id", F.col("event_id").alias("node"), F.struct("ts", "event_id").alias("seq"), "abnormal", F.lit(100).cast("long").alias("from_"))
    links = e.select("user_id", F.col("event_id").alias("node"), "parent", F.col("parent").alias("parent_seq"))
    return trace.analyse(held, links, ["user_id"], "from_", radius=2)


@query("stored_contents", "SELECT DISTINCT sha256(c_mktsegment) AS sha256, strlen(c_mktsegment)::INT AS size, true AS intact FROM customer")
def stored_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put twice, kept once, read back."""
    held = store.ContentStore(spark, _own_folder(spark, "store"))
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").cast("binary").alias("content"))
    held.put(c)
    return held.get(held.put(c)).select("sha256", F.octet_length("content").alias("size"), "intact")


@query("recorded_runs", "SELECT * FROM (VALUES ('a', 'three.zip', 'completed'), ('b', 'two.zip', 'failed'), ('best', 'two.zip', 'alias')) AS x(run_id, capsule, status)")
def recorded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = index.RunIndex(spark, _own_folder(spark, "index"))
    runs.record("a", "one.zip", alias="best")
    runs.record("b", "two.zip", alias="best", status="failed")
    runs.record("a", "three.zip", status="completed")
    best = capsules.resolve(runs.runs(), runs.aliases(), "best")
    return runs.runs().unionByName(best.select(F.lit("best").alias("run_id"), "capsule", F.lit("alias").alias("status")))


@query("capsule_scan", "SELECT 'n' || r_regionkey AS run_id, m AS member, CASE WHEN m = 'metrics.json' THEN '[' || r_regionkey || ']' END AS content FROM region, (VALUES ('manifest.json'), ('metrics.json'), ('run.json')) AS x(m)")
def capsule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder capsule per region, published by the driver, and all of them read by tasks: one member's content only."""
    folder = _own_folder(spark, "capsules")
    place = files.Files(spark, folder)
    for r in table(spark, sf_dir, "region").select("r_regionkey").collect():  # 5 rows
        index.publish(place, f"run{r.r_regionkey}", {"run_id": f"n{r.r_regionkey}", "status": "completed"}, {"metrics.json": f"[{r.r_regionkey}]".encode()})
    capsules.register(spark)
    rows = spark.read.format("capsule").option("members", "metrics.json").load(folder)
    return rows.where("error IS NULL").select("run_id", "member", F.col("content").cast("string").alias("content"))


@query("nested_config_diff", """SELECT user_id, 'a.' || (event_type = 'error')::INT AS path, 'changed' AS change FROM events WHERE event_id = -1 UNION ALL SELECT c_custkey AS user_id, 'net.layers.1' AS path, 'changed' AS change FROM customer UNION ALL SELECT c_custkey, 'net.act', 'removed' FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'seed', 'added' FROM customer WHERE c_custkey % 3 = 0""")
def nested_config_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    act = F.when(k % 2 == 0, F.lit("relu"))
    side = lambda width, act, seed: table(spark, sf_dir, "customer").select(k.alias("user_id"), F.to_json(F.struct(F.struct(F.array(F.lit(8), width).alias("layers"), act.alias("act")).alias("net"), seed.alias("seed"))).alias("json"))
    old = resources.nested_leaves(side(k, act, F.lit(None).cast("int")), ["user_id"], "json")
    new = resources.nested_leaves(side(k + 1, F.lit(None).cast("string"), F.when(k % 3 == 0, 7)), ["user_id"], "json")
    return resources.config_changes(old, new, ["user_id"]).select("user_id", "path", "change")


@query("capsule_comparison", "SELECT 'loss' AS name, 5 AS shared_observations, 0 AS unpaired_baseline_observations, 1 AS unpaired_candidate_observations, 0.5 AS estimate")
def capsule_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per region and side, paired by its declared trial; the candidate has one run more."""
    folder = _own_folder(spark, "groups")
    regions = sorted(r.r_regionkey for r in table(spark, sf_dir, "region").select("r_regionkey").collect())  # 5 rows
    for side, shift in (("baseline", 0.0), ("candidate", 0.5)):
        place = files.Files(spark, f"{folder}/{side}")
        for n in regions + ([99] if shift else []):
            metrics = [{"name": "loss", "values": [9.0, n + shift], "steps": [0, 1]}]
            index.publish(place, f"run{n}", {"run_id": f"{side}{n}", "status": "completed", "metadata": {"trial": n}}, capsules.structured_files({"metrics": metrics}))
    capsules.register(spark)
    rows = [spark.read.format("capsule").load(f"{folder}/{side}") for side in ("baseline", "candidate")]
    return groups.compare_groups(*rows, resamples=20).select("name", "shared_observations", "unpaired_baseline_observations", "unpaired_candidate_observations", "estimate")
