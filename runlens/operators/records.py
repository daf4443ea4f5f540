"""Evidence that runs carry in their metadata or their artifacts: which of several places counts, and how runs meet.

Runs are rows run_id, metadata (a JSON object) and, where there are any, replay_plan and rng_state (JSON objects).
Artifacts are rows run_id, name, sha256, content (text). The first place that has evidence counts.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import finite_or_null, identity_token, parity_passed

#: Metadata keys by which a run declares what it is paired by.
IDENTITY_KEYS = ("seed", "sample_id", "case_id", "replicate", "trial", "fold", "dataset_version", "configuration_id", "run_index")
#: Metadata keys and artifact names that may hold a kind of evidence, the first that has it wins.
CONFIGURATION_KEYS = ("configuration", "config", "parameters", "hyperparameters")
BEHAVIOUR_KEYS = ("behavior", "behavioral_evidence", "behavioral_fingerprint")
BEHAVIOUR_FILES = ("behavior.json", "behavioral_evidence.json", "behavioral_fingerprint.json", "predictions.json")
PARITY_KEYS = ("parity", "parity_result", "export_parity")
PARITY_FILES = ("parity.json", "parity_result.json")


def member(json: str | Column, path: str) -> Column:
    """A member of a JSON column as text; a JSON null is null."""
    return F.get_json_object(json, f"$.{path}")


def _object(json: str, path: str) -> Column:
    found = member(json, path)
    return F.when(F.ltrim(found).startswith("{"), found)


def declared_identity(runs: DataFrame) -> DataFrame:
    """Adds identity: the JSON object of declared keys in a fixed order (null where a run declares none), and pairable.

    The seed may stand in the configuration, the replay plan or the generator's state instead.
    """
    parts = {k: member("metadata", k) for k in IDENTITY_KEYS}
    elsewhere = [member("metadata", "configuration.seed"), *(member(c, "seed") for c in ("replay_plan", "rng_state") if c in runs.columns)]
    parts["seed"] = F.coalesce(parts["seed"], *elsewhere)
    whole = F.to_json(F.struct(*[c.alias(k) for k, c in sorted(parts.items())]))  # leaves out nulls
    return runs.withColumn("identity", F.when(whole != "{}", whole)).withColumn("pairable", F.col("identity").isNotNull())


def pair_members(baseline: DataFrame, candidate: DataFrame, order: str = "run_id") -> DataFrame:
    """baseline_run, candidate_run of runs with identity and pairable columns.

    One run a side is a pair whatever it declares. Otherwise runs meet by identity, those that share one in their
    order; position among all runs is no identity.
    """
    place = F.row_number().over(Window.partitionBy("identity").orderBy(order))
    side = lambda df, name: df.where("pairable").select("identity", place.alias("place"), F.col("run_id").alias(name))
    paired = side(baseline, "baseline_run").join(side(candidate, "candidate_run"), ["identity", "place"]).select("baseline_run", "candidate_run")
    only = lambda df, name: df.agg(F.count(F.lit(1)).alias(f"{name}_n"), F.first("run_id").alias(name))
    alone = only(baseline, "baseline_run").join(F.broadcast(only(candidate, "candidate_run")), F.lit(True)).where("baseline_run_n = 1 AND candidate_run_n = 1")  # one row each
    return paired.unionByName(alone.select("baseline_run", "candidate_run")).distinct()


def configuration(metadata: str | Column = "metadata") -> Column:
    """The first of a run's configuration objects; an empty one where there is none."""
    return F.coalesce(*[_object(metadata, k) for k in CONFIGURATION_KEYS], F.lit("{}"))


def known_artifact(artifacts: DataFrame, names: Sequence[str], alias: str) -> DataFrame:
    """run_id, alias: per run the first artifact by name whose file name is one of names and that is a JSON object."""
    base = F.lower(F.element_at(F.split("name", "/"), -1))
    parsed = F.try_parse_json("content")
    usable = artifacts.where(base.isin(*names) & F.col("sha256").isNotNull() & F.schema_of_variant(parsed).startswith("OBJECT"))
    return usable.groupBy("run_id").agg(F.min_by("content", "name").alias(alias))


def behaviour_evidence(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """run_id, behaviour: an object of the metadata, else its predictions with labels and features, else an artifact."""
    predictions = member("metadata", "predictions")
    triple = F.when(F.ltrim(predictions).startswith("["), F.to_json(F.struct(predictions.alias("predictions"), member("metadata", "labels").alias("labels"), member("metadata", "features").alias("features"))))
    own = runs.select("run_id", F.coalesce(*[_object("metadata", k) for k in BEHAVIOUR_KEYS], triple).alias("own_"))
    return own.join(known_artifact(artifacts, BEHAVIOUR_FILES, "file_"), "run_id", "left").select("run_id", F.coalesce("own_", "file_").alias("behaviour"))


def parity_evidence(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """run_id, evidence: the first parity result of the metadata, else an artifact's."""
    own = runs.select("run_id", F.coalesce(*[member("metadata", k) for k in PARITY_KEYS]).alias("own_"))
    return own.join(known_artifact(artifacts, PARITY_FILES, "file_"), "run_id", "left").select("run_id", F.coalesce("own_", "file_").alias("evidence"))


def member_parity(runs: DataFrame, evidence: DataFrame) -> DataFrame:
    """run_id, parity of runs with parity evidence; what tells neither pass nor fail is null."""
    told = F.lower(F.trim(member("evidence", "passed")))
    passed = F.when(told == "true", True).when(told == "false", False)
    return runs.select("run_id").join(evidence.where("evidence IS NOT NULL"), "run_id").select("run_id", parity_passed(passed, F.coalesce(member("evidence", "status"), F.col("evidence"))).alias("parity"))


def resource_samples(series: DataFrame, observations: DataFrame, by: list[str]) -> DataFrame:
    """by..., identity, value: finite values of resource series and of observations that stand alone.

    Both have by..., identity (null if not declared), value. A group keeps its identities only if all its finite
    values declare one.
    """
    both = series.select(*by, "identity", "value").unionByName(observations.select(*by, "identity", "value"))
    finite = both.withColumn("value", finite_or_null(F.col("value"))).where("value IS NOT NULL")
    declared = F.bool_and(F.col("identity").isNotNull()).over(Window.partitionBy(*by))
    return finite.withColumn("identity", F.when(declared, F.col("identity")))


def observation_names(observations: DataFrame, kind: str) -> DataFrame:
    """name: names of a kind that occur among observations; one without a kind is a metric."""
    own = F.coalesce(F.col("kind"), F.lit("metric"))
    return observations.where((own == kind) & (F.length("name") > 0)).select("name").distinct()


def dataset_fingerprints(datasets: DataFrame) -> DataFrame:
    """name, split, format, sha256, uri, sample_count: one identifying record per registered dataset.

    datasets has name, split, format, artifact and metadata (JSON objects); the artifact's digest and address count
    before those of the metadata.
    """
    first = lambda key: F.coalesce(member("artifact", key), member("metadata", key))
    count = F.coalesce(member("metadata", "sample_count"), member("metadata", "row_count")).cast("long")
    return datasets.select("name", "split", "format", first("sha256").alias("sha256"), first("uri").alias("uri"), count.alias("sample_count"))


def referenced_payloads(payloads: DataFrame, artifacts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Payloads that something still refers to: evidence text that holds their digest, or an artifact that isn't a
    replay state. payloads has sha256; artifacts sha256 and role; evidence json."""
    named = evidence.select(F.explode(F.regexp_extract_all("json", F.lit(r"\b([0-9a-f]{64})\b"))).alias("sha256"))
    kept = artifacts.where(F.coalesce(F.col("role") != "replay_state", F.lit(True))).select("sha256")
    return payloads.join(named.unionByName(kept).distinct(), "sha256", "left_semi")


def identities(runs: DataFrame) -> DataFrame:
    """run_id, token of runs that declare an identity."""
    return declared_identity(runs).where("pairable").select("run_id", identity_token(F.col("identity"), T.StringType()).alias("token"))


def parse_thresholds(values: Iterable[str]) -> dict[str, float]:
    """metric=value items; the value is a finite number that isn't negative."""
    out: dict[str, float] = {}
    for item in values:
        name, equals, text = item.partition("=")
        try:
            number = float(text)
        except ValueError:
            number = math.nan
        if not equals or not name.strip() or not 0 <= number < math.inf:
            raise ValueError(f"not a threshold (metric=value, finite and not negative): {item}")
        out[name.strip()] = number
    return out


def rendered_top(rows: DataFrame, order: Sequence[str | Column], top: int = 10) -> tuple[list[dict], int]:
    """The first rows of an order as dictionaries, and how many there are besides, for a report."""
    first = [json.loads(r.j) for r in rows.orderBy(*order).limit(top).select(F.to_json(F.struct(*rows.columns)).alias("j")).collect()]
    return first, rows.count() - len(first)


def slice_examples(rows: DataFrame, by: list[str], row: str = "row_idx", top: int = 20) -> DataFrame:
    """by..., examples: the `top` smallest row numbers of each slice, of which no more are gathered."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(row))
    return rows.select(*by, row).withColumn("rank_", rank).where(F.col("rank_") <= top).groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("examples"))
