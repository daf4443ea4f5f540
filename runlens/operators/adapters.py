"""Features computed in three ways, compared row by row; and seeded experiments run as a table."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table_parity

RUNS = "seed long, status string, value string, error string"


def row_features(df: DataFrame, function: Callable[[dict[str, Any]], Mapping[str, Any]], schema: str, keep: list[str]) -> DataFrame:
    """keep... and the columns of schema, by a function of one row, called in Arrow batches."""
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c in keep]

    def run(source: Iterator[Any]) -> Iterator[Any]:
        import pandas as pd

        for pdf in source:
            made = [dict(function(r)) for r in pdf.to_dict("records")]
            yield pd.concat([pdf[keep].reset_index(drop=True), pd.DataFrame(made, index=range(len(pdf)))], axis=1)

    return df.mapInPandas(run, ", ".join([*kinds, schema]))


def batch_features(df: DataFrame, function: Callable[[Any], Any], schema: str) -> DataFrame:
    """The columns of schema, by a function from one pandas frame to another; each call sees a part of the rows, so it
    must not depend on which."""
    return df.mapInPandas(lambda source: (function(pdf) for pdf in source), schema)


def sql_features(df: DataFrame, query: str, table: str = "data", parameters: Mapping[str, Any] | None = None) -> DataFrame:
    """The result of a query over a table that is df; parameters are bound, never pasted. A view of that name that is
    there already is an error; ours is gone afterwards."""
    spark = df.sparkSession
    if spark.catalog.tableExists(table):
        raise ValueError(f"there is a table called {table}")
    df.createTempView(table)
    try:
        return spark.sql(query, args=dict(parameters or {}))
    finally:
        spark.catalog.dropTempView(table)


def feature_parity(data: DataFrame, reference: Callable[[DataFrame], DataFrame], candidate: Callable[[DataFrame], DataFrame], row: str = "row_idx", **policy: Any) -> DataFrame:
    """The mismatches of two ways to compute features from the same data."""
    return table_parity(reference(data), candidate(data), row, **policy)


def run_seeds(spark: SparkSession, runner: Callable[..., Any], seeds: Iterable[int], options: Mapping[str, Any] | None = None, fail_fast: bool = False) -> DataFrame:
    """seed, status (completed or failed), value (JSON), error of a runner called once a seed, one task each.

    Python's and NumPy's generators are seeded before each call. A failure is a row; with fail_fast it is an error.
    """
    listed = list(seeds)
    if not all(isinstance(s, int) and not isinstance(s, bool) for s in listed):
        raise TypeError("seeds are whole numbers")
    given = dict(options or {})

    def run(source: Iterator[Any]) -> Iterator[Any]:
        import random

        import numpy as np
        import pandas as pd

        for pdf in source:
            rows = []
            for seed in pdf["seed"].tolist():
                random.seed(seed)
                np.random.seed(seed % 2**32)
                try:
                    rows.append((seed, "completed", json.dumps(runner(seed, **given), sort_keys=True), None))
                except Exception as e:  # an experiment may fail in any way; the failure is the result
                    if fail_fast:
                        raise
                    rows.append((seed, "failed", None, f"{type(e).__module__}.{type(e).__qualname__}: {e}".removeprefix("builtins.")))
            yield pd.DataFrame(rows, columns=["seed", "status", "value", "error"])

    table = spark.createDataFrame([(s,) for s in listed], "seed long").repartition(max(1, len(listed)))
    return table.mapInPandas(run, RUNS)


def failures_of(runs: DataFrame) -> DataFrame:
    """id, kind, error_type, message of failed runs, for failures.groups and failures.matches."""
    return runs.where("status = 'failed'").select(F.col("seed").alias("id"), F.lit("exception").alias("kind"), F.regexp_extract("error", r"^([\w.]+): ", 1).alias("error_type"), F.regexp_replace("error", r"^[\w.]+: ", "").alias("message"))
