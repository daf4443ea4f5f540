"""Executors run the operators without a copy of the package on their path."""

import os
import subprocess
import sys
from pathlib import Path

from .helpers import SF

REPO = str(Path(__file__).resolve().parents[2])
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__
for name, query in __spark_entry__.queries().items():
    if name[:2] == "op" and name[2].isdigit() or name in ("pipeline", "python_lineage", "model_comparison", "feature_ways", "capsule_scan", "seeded_runs", "nested_leaves"):
        print(name, query(spark, {sf!r}).count())
"""


def test_without_the_package_on_the_workers_path(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO, sf=SF)], cwd=tmp_path, env=env, capture_output=True, text=True, check=False)
    assert got.returncode == 0, got.stderr[-3000:]
    assert len(got.stdout.strip().split("\n")) == 17
