"""Paired experiments over `events`: baseline clicks against other event types, paired by user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.decisions import improvement, noninferior, regression
from ..functions.values import finite_or_null, metric_higher_is_better, observation_state, relative_delta
from ..operators import comparison, gate, pairing, statistics
from .registry import query, table

RESAMPLES, SEED = 200, 7


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name (event type), token (user), value: the mean per user and type."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("name"), F.col("user_id").alias("token")).agg(F.avg("value").alias("value"))


def sides(spark: SparkSession, sf_dir: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Clicks as the baseline of each named event type, and those types as candidates."""
    obs = observations(spark, sf_dir)
    base = obs.where("name = 'click'").select(F.explode(F.array(*[F.lit(n) for n in names])).alias("name"), "token", "value")
    return base, obs.where(F.col("name").isin(names))


OBS = "o AS (SELECT event_type AS name, user_id AS token, avg(value) AS value FROM events GROUP BY 1, 2)"
PAIRS = f"{OBS}, p AS (SELECT c.name, c.token, b.value AS baseline, c.value AS candidate, c.value - b.value AS difference FROM o b JOIN o c USING (token) WHERE b.name = 'click' AND c.name <> 'click')"


def resamples_sql(source: str, by: str, value: str, order: str, n: int = RESAMPLES, seed: int = SEED, tag: str = "") -> str:
    """CTEs i{tag}, s{tag} (r, s): the hashed resamples' means, as in operators.statistics."""
    return f"""
i{tag} AS (SELECT {by}, {value} AS value, row_number() OVER (PARTITION BY {by} ORDER BY {order}) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {source}),
d{tag} AS (SELECT {by}, r, CAST('0x' || substr(md5('{seed}:' || r || ':' || i), 1, 8) AS BIGINT) % n AS i FROM i{tag}, range({n}) AS t(r)),
s{tag} AS (SELECT {by}, r, avg(value) AS s FROM d{tag} JOIN i{tag} USING ({by}, i) GROUP BY {by}, r)"""


BOUNDS = "quantile_cont(s, 0.025) AS lower, quantile_cont(s, 0.975) AS upper, least(1.0, 2 * least(avg(CASE WHEN s <= 0 THEN 1.0 ELSE 0.0 END), 1 - avg(CASE WHEN s <= 0 THEN 1.0 ELSE 0.0 END))) AS p_value"
OTHERS = ["error", "purchase", "signup", "view"]


def paired(spark: SparkSession, sf_dir: str, names: list[str] = OTHERS) -> DataFrame:
    base, cand = sides(spark, sf_dir, names)
    return pairing.paired_differences(pairing.paired_observations(base, cand, ["name"]))


@query("paired_delta", f"WITH {PAIRS} SELECT name, token, baseline, candidate, difference FROM p")
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(spark, sf_dir).select("name", "token", "baseline", "candidate", "difference")


@query("paired_bootstrap", f"WITH {PAIRS}, {resamples_sql('p', 'name', 'difference', 'token')}, w AS (SELECT name, count(*) AS n, avg(difference) AS estimate FROM p GROUP BY name) SELECT name, any_value(w.n) AS n, any_value(estimate) AS estimate, {BOUNDS} FROM s JOIN w USING (name) GROUP BY name")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.bootstrap(paired(spark, sf_dir), ["name"], ["token"], "difference", RESAMPLES, SEED)


DECIDED = f"""WITH {PAIRS}, {resamples_sql('p', 'name', 'difference', 'token')},
b AS (SELECT name, {BOUNDS} FROM s GROUP BY name), e AS (SELECT name, avg(difference) AS estimate FROM p GROUP BY name),
j AS (SELECT name, estimate, lower, upper, name <> 'error' AS higher FROM b JOIN e USING (name))
SELECT name, higher AS higher_is_better, CASE WHEN higher THEN upper < -1.0 ELSE lower > 1.0 END AS regression,
CASE WHEN higher THEN lower > 1.0 ELSE upper < -1.0 END AS improvement,
CASE WHEN higher THEN lower ELSE -upper END >= -5.0 AS noninferior FROM j"""


@query("regression_decisions", DECIDED)
def regression_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = paired_bootstrap(spark, sf_dir).withColumn("higher_is_better", metric_higher_is_better(F.col("name")))
    args = (F.col("lower"), F.col("upper"), F.col("higher_is_better"))
    return stats.select("name", "higher_is_better", regression(F.col("estimate"), *args, F.lit(1.0)).alias("regression"), improvement(F.col("estimate"), *args, F.lit(1.0)).alias("improvement"), noninferior(*args, F.lit(5.0)).alias("noninferior"))


@query("independent_bootstrap", f"""WITH p AS (SELECT 1 AS g, event_id, value FROM events WHERE event_type = 'purchase'), q AS (SELECT 1 AS g, event_id, value FROM events WHERE event_type = 'signup'),
{resamples_sql('p', 'g', 'value', 'event_id', 50, 3, '1')}, {resamples_sql('q', 'g', 'value', 'event_id', 50, 4, '2')},
d AS (SELECT s2.s - s1.s AS s FROM s1 JOIN s2 USING (r))
SELECT (SELECT avg(value) FROM p) AS baseline, (SELECT avg(value) FROM q) AS candidate, {BOUNDS} FROM d""")
def independent_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("g", F.lit(1))
    side = lambda n: e.where(F.col("event_type") == n).select("g", "event_id", "value")
    out = statistics.independent_bootstrap(side("purchase"), side("signup"), ["g"], ["event_id"], "value", 50, 3)
    return out.select("baseline", "candidate", "lower", "upper", "p_value")


@query("effect_size", f"WITH {PAIRS} SELECT name, count(*) AS n, avg(difference) AS mean, stddev_samp(difference) AS sd, CASE WHEN count(*) < 2 THEN NULL WHEN stddev_samp(difference) = 0 THEN CASE WHEN avg(difference) = 0 THEN 0.0 WHEN avg(difference) > 0 THEN CAST('inf' AS DOUBLE) ELSE CAST('-inf' AS DOUBLE) END ELSE avg(difference) / stddev_samp(difference) END AS effect_size FROM p GROUP BY name")
def effect_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.effect_size(paired(spark, sf_dir), ["name"])


HALVES = "CASE WHEN event_id % 97 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 89 = 0 THEN NULL ELSE value END"
QUALITY = f"""WITH e AS (SELECT event_type AS name, user_id AS token, ts, {HALVES} AS value, event_id FROM events),
s AS (SELECT name, token, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'b' ELSE 'c' END AS side, value, event_id FROM e),
k AS (SELECT *, count(*) OVER (PARTITION BY name, side, token) = 1 AS ok, value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value) AS fin FROM s),
t AS (SELECT name, side, ok, fin, CASE WHEN ok THEN 'id' || token ELSE side || '#' || event_id END AS t FROM k),
j AS (SELECT coalesce(b.name, c.name) AS name, b.t IS NOT NULL AS bt, c.t IS NOT NULL AS ct, b.fin AS bf, c.fin AS cf, b.ok AS bo, c.ok AS co FROM (SELECT * FROM t WHERE side = 'b') b FULL JOIN (SELECT * FROM t WHERE side = 'c') c ON b.name = c.name AND b.t = c.t),
a AS (SELECT name, count(*) FILTER (WHERE bt) AS baseline_observations, count(*) FILTER (WHERE ct) AS candidate_observations, count(*) FILTER (WHERE bt AND ct) AS shared_observations,
count(*) FILTER (WHERE bt AND ct AND bf AND cf) AS paired_finite_observations, count(*) FILTER (WHERE bt AND NOT bf) AS baseline_nonfinite, count(*) FILTER (WHERE ct AND NOT cf) AS candidate_nonfinite,
count(*) FILTER (WHERE bt AND ct AND NOT (bf AND cf)) AS shared_nonfinite, count(*) FILTER (WHERE bt AND NOT ct) AS unpaired_baseline_observations, count(*) FILTER (WHERE ct AND NOT bt) AS unpaired_candidate_observations,
count(*) FILTER (WHERE bo) AS bp, count(*) FILTER (WHERE co) AS cp FROM j GROUP BY name)
SELECT * EXCLUDE (bp, cp), unpaired_baseline_observations + unpaired_candidate_observations AS unpaired_observations,
candidate_observations = 0 OR (unpaired_baseline_observations > 0 AND cp > 0) AS candidate_missing, baseline_observations = 0 OR (unpaired_candidate_observations > 0 AND bp > 0) AS baseline_missing FROM a"""


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with NaN and null values put in by rule, as the test data has none."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("value", F.when(F.col("event_id") % 97 == 0, float("nan")).when(F.col("event_id") % 89 != 0, F.col("value")))


@query("pairing_quality", QUALITY)
def pairing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = dirty_events(spark, sf_dir).select(F.col("event_type").alias("name"), F.col("user_id").alias("token"), "ts", "value")
    return pairing.pairing_quality(e.where("ts < '2024-01-16'"), e.where("ts >= '2024-01-16'"), ["name"])


@query("identity_ambiguity", """WITH e AS (SELECT event_type, CASE WHEN event_id % 50 = 0 THEN NULL ELSE user_id * 1000 + day(ts) END AS token FROM events),
p AS (SELECT event_type, CASE WHEN token IS NULL THEN 'missing' WHEN count(*) OVER (PARTITION BY event_type, token) > 1 THEN 'ambiguous' ELSE 'declared' END AS pairing FROM e)
SELECT event_type, pairing, count(*) AS n FROM p GROUP BY 1, 2""")
def identity_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 50 != 0, F.col("user_id") * 1000 + F.dayofmonth("ts")).alias("token"))
    return pairing.ambiguity(e, ["event_type"], "token").groupBy("event_type", "pairing").agg(F.count(F.lit(1)).alias("n"))


@query("sample_design", """WITH e AS (SELECT event_type AS name, CASE WHEN event_type = 'view' OR (event_type = 'error' AND ts >= TIMESTAMP '2024-01-16') THEN NULL WHEN event_type = 'click' THEN event_id ELSE user_id END AS token, ts >= TIMESTAMP '2024-01-16' AS c FROM events),
g AS (SELECT name, c, token, count(*) AS n FROM e GROUP BY ALL),
s AS (SELECT name, c, max(token IS NOT NULL AND n > 1) AS rep, max(token IS NULL) AS none FROM g GROUP BY 1, 2)
SELECT coalesce(b.name, k.name) AS name, CASE WHEN coalesce(b.none, true) AND coalesce(k.none, true) THEN 'independent' WHEN coalesce(b.none, true) OR coalesce(k.none, true) THEN 'incompatible' WHEN b.rep OR k.rep THEN 'ambiguous' ELSE 'stable_identity' END AS pairing
FROM (SELECT * FROM s WHERE NOT c) b FULL JOIN (SELECT * FROM s WHERE c) k USING (name)""")
def sample_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    token = F.when((F.col("event_type") == "view") | ((F.col("event_type") == "error") & late), F.lit(None)).when(F.col("event_type") == "click", F.col("event_id")).otherwise(F.col("user_id"))
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), token.alias("token"), late.alias("c"))
    return pairing.sample_design(e.where("NOT c"), e.where("c"), ["name"])


@query("last_finite", f"""WITH e AS (SELECT user_id, event_type, ts, event_id, {HALVES} AS value FROM events),
k AS (SELECT *, value IS NOT NULL AND NOT isnan(value) AS fin FROM e)
SELECT user_id, event_type, coalesce(arg_max(value, (ts, event_id)) FILTER (WHERE fin), arg_max_null(value, (ts, event_id))) AS outcome, count(*) AS observations, count(*) FILTER (WHERE NOT fin) AS nonfinite_within FROM k GROUP BY 1, 2""")
def last_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.last_finite(dirty_events(spark, sf_dir), ["user_id", "event_type"], ["ts", "event_id"])


STATE_SQL = "CASE WHEN event_id % 41 = 0 THEN 'failed' WHEN event_id % 37 = 0 THEN 'missing' WHEN event_id % 31 = 0 THEN 'nan' WHEN event_id % 29 = 0 THEN 'pos_inf' WHEN event_id % 23 = 0 THEN 'neg_inf' ELSE 'finite' END"


@query("observation_states", f"SELECT event_type, {STATE_SQL} AS state, count(*) AS n, sum(CASE WHEN {STATE_SQL} = 'finite' THEN value END) AS finite_sum FROM events GROUP BY 1, 2")
def observation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    odd = F.when(i % 37 == 0, F.lit(None).cast("double")).when(i % 31 == 0, float("nan")).when(i % 29 == 0, float("inf")).when(i % 23 == 0, float("-inf")).otherwise(F.col("value"))
    e = table(spark, sf_dir, "events").withColumn("value", odd)
    state = observation_state(F.col("value"), i % 41 == 0)
    return e.groupBy("event_type", state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(state == "finite", finite_or_null(F.col("value")))).alias("finite_sum"))


@query("relative_deltas", f"WITH {OBS}, m AS (SELECT name, avg(value) AS v FROM o GROUP BY name) SELECT a.name AS baseline_name, b.name AS candidate_name, CASE WHEN a.v <> 0 THEN (b.v - a.v) / abs(a.v) END AS relative_delta FROM m a JOIN m b ON a.name < b.name")
def relative_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = observations(spark, sf_dir).groupBy("name").agg(F.avg("value").alias("v"))
    a, b = m.select(F.col("name").alias("baseline_name"), F.col("v").alias("a")), m.select(F.col("name").alias("candidate_name"), F.col("v").alias("b"))
    return a.join(F.broadcast(b), F.col("baseline_name") < F.col("candidate_name")).select("baseline_name", "candidate_name", relative_delta(F.col("a"), F.col("b")).alias("relative_delta"))


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, cand = sides(spark, sf_dir, OTHERS)
    return comparison.compare(base, cand, thresholds={n: 1.0 for n in OTHERS}, margins={"view": 5.0}, resamples=RESAMPLES, seed=SEED)


COMPARED = f"""WITH {PAIRS}, {resamples_sql('p', 'name', 'difference', 'token')},
b AS (SELECT name, {BOUNDS} FROM s GROUP BY name), e AS (SELECT name, count(*) AS n, avg(difference) AS estimate FROM p GROUP BY name),
q AS (SELECT t.name, count(*) FILTER (WHERE o1.token IS NOT NULL AND o2.token IS NOT NULL) AS shared, count(*) FILTER (WHERE o2.token IS NULL) AS ub, count(*) FILTER (WHERE o1.token IS NULL) AS uc
  FROM (SELECT n.name, u.token FROM (SELECT DISTINCT name FROM o WHERE name <> 'click') n, (SELECT DISTINCT token FROM o) u) t
  LEFT JOIN (SELECT * FROM o WHERE name = 'click') o1 ON o1.token = t.token LEFT JOIN o o2 ON o2.token = t.token AND o2.name = t.name
  WHERE o1.token IS NOT NULL OR o2.token IS NOT NULL GROUP BY t.name),
j AS (SELECT q.*, e.n, estimate, lower, upper, q.name <> 'error' AS higher FROM q LEFT JOIN e USING (name) LEFT JOIN b USING (name)),
dd AS (SELECT *, CASE WHEN higher THEN upper < -1.0 ELSE lower > 1.0 END AS regression, ub > 0 OR uc > 0 AS missing, CASE WHEN higher THEN lower ELSE -upper END AS bound FROM j)
SELECT name, shared AS shared_observations, ub AS unpaired_baseline_observations, uc AS unpaired_candidate_observations, estimate, lower, upper, regression,
CASE WHEN regression THEN 'fail' WHEN n < 2 OR missing THEN 'inconclusive' WHEN name = 'view' AND NOT (bound >= -5.0) THEN 'fail' ELSE 'pass' END AS status FROM dd"""


@query("compare_runs", COMPARED)
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir).select("name", "shared_observations", "unpaired_baseline_observations", "unpaired_candidate_observations", "estimate", "lower", "upper", "regression", "status")


@query("gate_checks", f"""WITH c AS ({COMPARED}), f AS (SELECT count(*) FILTER (WHERE regression) AS r, string_agg(name, ',' ORDER BY name) FILTER (WHERE regression) AS names, count(*) FILTER (WHERE unpaired_baseline_observations > 0 OR unpaired_candidate_observations > 0) AS m, count(*) FILTER (WHERE shared_observations = 0 OR status = 'inconclusive') AS t FROM c)
SELECT 'no metric regression' AS name, 'no_metric_regression' AS check_id, CASE WHEN r > 0 THEN 'fail' ELSE 'pass' END AS status, coalesce(names, '') AS details FROM f
UNION ALL SELECT 'no non-finite candidate observations', 'no_non_finite_candidate_observations', 'pass', '0'
UNION ALL SELECT 'no non-finite baseline observations', 'no_non_finite_baseline_observations', 'pass', '0'
UNION ALL SELECT 'evidence present', 'evidence_present', CASE WHEN m > 0 THEN 'fail' ELSE 'pass' END, CAST(m AS VARCHAR) FROM f
UNION ALL SELECT 'sufficient evidence', 'sufficient_evidence', CASE WHEN t > 0 THEN 'fail' ELSE 'pass' END, CAST(t AS VARCHAR) FROM f""")
def gate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.checks(compared(spark, sf_dir))


@query("run_health", """SELECT CASE WHEN user_id % 2 = 0 THEN 'baseline' ELSE 'candidate' END AS side, bool_or(event_type = 'error') AS any_failed, bool_or(event_type NOT IN ('error', 'purchase')) AS any_incomplete, count(DISTINCT CASE WHEN event_type = 'error' THEN user_id END) AS failed_runs FROM events GROUP BY 1""")
def run_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("running")
    runs = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 2 == 0, "baseline").otherwise("candidate").alias("side"), status.alias("status"), F.col("user_id").alias("run_id"))
    return comparison.run_health(runs).withColumn("failed_runs", F.size("failed_runs").cast("long"))


@query("group_parity", """WITH m AS (SELECT user_id % 7 AS g, CASE WHEN user_id % 7 = 0 AND event_type = 'error' THEN false WHEN user_id % 7 = 1 AND event_type = 'view' THEN NULL ELSE true END AS p FROM events)
SELECT g, CASE WHEN bool_or(coalesce(NOT p, false)) THEN false WHEN count(*) FILTER (WHERE p IS NULL) = 0 THEN true END AS parity FROM m GROUP BY g""")
def group_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("user_id") % 7
    p = F.when((g == 0) & (F.col("event_type") == "error"), F.lit(False)).when((g == 1) & (F.col("event_type") == "view"), F.lit(None)).otherwise(F.lit(True))
    return comparison.group_parity(table(spark, sf_dir, "events").select(g.alias("g"), p.alias("parity")), ["g"])


@query("first_runs", "SELECT user_id AS run_id, arg_min(event_type, event_id) AS status, min(event_id) AS arrival FROM events GROUP BY user_id")
def first_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("status"), F.col("event_id").alias("arrival"))
    return pairing.first_runs(runs)
