"""A choice of queries against their SQL twins in DuckDB, and the entry points."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__
from runlens.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOICE = (
    "paired_delta regression_decisions pairing_quality identity_ambiguity sample_design last_finite observation_states gate_checks prediction_changes ece slices_pairs resource_regressions config_diff "
    "feature_parity_cells table_fingerprint output_parity trace_window missing_parents line_range_join retention_plan queue_blocked bisect_first_bad sensitive_findings failure_groups sql_lineage diff_lines "
    "calibration_interval merged_evidence poisson_bootstrap python_lineage resource_interval bisect_scores failure_matches resource_summary slices_numeric slices_worst lineage_events ddmin_rows "
    "run_identity member_pairs parity_members behaviour_source resource_samples live_payloads change_roots impact_plan impact_report relationship_edges graph_load dvc_stages feature_ways seeded_runs trace_analysis "
    "capsule_scan recorded_runs stored_contents nested_config_diff nested_leaves model_comparison shell_lineage notebook_lineage openlineage_out live_windows live_ring live_queue"
).split()


def normal(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str([normal(x) for x in v]) if isinstance(v, list | tuple) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def ordered(rows, names):
    at = [names.index(n) for n in sorted(names)]
    return sorted(tuple(normal(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", CHOICE)
def test_twin(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    twin = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(twin.columns)
    assert ordered(df.collect(), df.columns) == ordered(twin.fetchall(), list(twin.columns))


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() > 0
    queries = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(queries) and len(queries) > 80
