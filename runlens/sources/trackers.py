"""Runs from and to experiment trackers, by whatever client object the caller has.

A client for metrics has get_run(id), get_metric_history(id, name), start_run(run_id=...), log_param, log_metric and
log_artifact; one for artifacts has artifact(path, name) with download(folder). No tracker is needed to import this.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = "run_id string, status string, name string, step long, value double"
#: What trackers call a run's state, and what it is called here.
STATES = {"finished": "completed", "success": "completed", "failed": "failed", "killed": "failed", "crashed": "failed"}


def _at(value: Any, name: str, default: Any = None) -> Any:
    return value.get(name, default) if isinstance(value, dict) else getattr(value, name, default)


def import_runs(spark: SparkSession, client: Callable[[], Any], run_ids: Iterable[str]) -> DataFrame:
    """run_id, status, name, step, value: the metric histories of runs, fetched by tasks.

    `client` makes a client where it is called. A metric without a history has its last value at step 0.
    """

    def run(source: Iterator[Any]) -> Iterator[Any]:
        import pandas as pd

        own = client()
        for pdf in source:
            rows = []
            for run_id in pdf["run_id"]:
                found = own.get_run(run_id)
                state = str(_at(_at(found, "info", {}), "status", "finished")).lower()
                for name, last in (_at(_at(found, "data", {}), "metrics", {}) or {}).items():
                    history = own.get_metric_history(run_id, name) if hasattr(own, "get_metric_history") else []
                    points = [(_at(p, "step", i), _at(p, "value")) for i, p in enumerate(history)] or [(0, last)]
                    rows += [(run_id, STATES.get(state, state), name, int(s), float(v)) for s, v in points]
            yield pd.DataFrame(rows, columns=["run_id", "status", "name", "step", "value"])

    return spark.createDataFrame([(r,) for r in run_ids], "run_id string").mapInPandas(run, METRICS)


def import_capsule(client: Any, run_path: str, artifact: str, folder: str) -> str:
    """Download a capsule that a tracker holds as an artifact; its place is read with format("capsule")."""
    return str(client.artifact(run_path, artifact).download(folder))


def export_run(client: Any, run: dict[str, Any], metrics: DataFrame, capsule: str | None = None, run_id: str | None = None) -> str | None:
    """Log a run's metadata, its metrics in order of name and step, and its capsule; returns the tracker's run id.

    Metrics are those of one run and are passed one by one, never gathered at once.
    """
    with client.start_run(run_id=run_id) if run_id else client.start_run() as active:
        for key, value in (run.get("metadata") or {}).items():
            client.log_param(str(key), value if isinstance(value, str) else json.dumps(value, sort_keys=True))
        for row in metrics.select("name", "step", F.col("value").cast("double").alias("value")).orderBy("name", "step").toLocalIterator():
            client.log_metric(row.name, row.value, step=row.step)
        if capsule:
            client.log_artifact(capsule)
        return _at(_at(active, "info", {}), "run_id", run_id)
