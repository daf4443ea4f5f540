import json

from pyspark.sql import functions as F

from runlens.operators import failures, readers

PY = '''
import os, numpy as np
from a.b import c
from . import sib
class K(Base):
    @deco
    def m(self):
        pd.read_csv("data/in.csv").to_parquet("out/x.parquet")
        open("log.txt", "w"); open(f"{d}/y.csv")
        importlib.import_module(name)
        spark.sql("insert into t select * from s")
'''
YAML = """
stages:
  train:
    cmd: python train.py --out model.pt < feed.csv
    deps:
      - data/train.csv
      - path: conf.yaml
    outs: [model.pt, 'report.json']
  eval:
    needs: train
    steps:
      - run: bash eval.sh > scores.json
"""


def names(edges, relation):
    return {n for n, r, _ in edges if r == relation}


def test_python():
    e = readers.read_python(PY)
    assert names(e, "imports") >= {"os", "numpy", "a.b.c", ".sib", "name"} and names(e, "inherits") == {"Base"}
    assert names(e, "defines_class") == {"K"} and names(e, "defines_function") == {"K.m"} and names(e, "decorated_by") == {"deco"}
    assert names(e, "reads") >= {"data/in.csv", "s"} and names(e, "writes") >= {"out/x.parquet", "log.txt", "t"}
    assert any(c == "dynamic" for _, r, c in e if r == "reads")


def test_shell_and_pipelines():
    e = readers.read_shell("python3 run.py --input=data/a.csv -o out/b.json < c.txt >> d.log | cat # x\ndvc run -d dep.csv -o res.csv cmd")
    assert names(e, "runs") == {"run.py"} and names(e, "reads") >= {"data/a.csv", "c.txt", "dep.csv"} and names(e, "writes") >= {"out/b.json", "d.log", "res.csv"}
    assert readers.yaml_subset(YAML)["stages"]["train"]["outs"] == ["model.pt", "report.json"]
    e = readers.read_pipeline(YAML)
    assert names(e, "reads") >= {"data/train.csv", "conf.yaml", "feed.csv", "train"} and names(e, "writes") >= {"model.pt", "report.json", "scores.json"} and names(e, "runs") == {"train.py", "eval.sh"}


def test_notebook_and_dispatch(spark):
    cells = [{"cell_type": "code", "source": ["%%sql\n", "select * from t"]}, {"cell_type": "code", "source": "!python prep.py\nimport os\n"}, {"cell_type": "markdown", "source": "import no"}, {"cell_type": "code", "source": "def"}]
    book = json.dumps({"cells": cells})
    e = readers.read_notebook(book)
    assert names(e, "reads") == {"t"} and names(e, "runs") == {"prep.py"} and names(e, "imports") == {"os"} and names(e, "unreadable") == {"cell"}
    files = spark.createDataFrame([("n.ipynb", book), ("pkg/m.py", "import pkg.other"), ("pkg/other.py", ""), ("bad.py", "def"), ("broken.ipynb", "{"), ("x.bin", "?"), ("q.sql", None), ("dvc.yaml", YAML)], "path string, text string")
    edges = readers.read_sources(files)
    got = {(r.id, r.relation) for r in edges.collect()}
    assert ("bad.py", "unreadable") in got and ("broken.ipynb", "unreadable") in got and ("dvc.yaml", "writes") in got and not any(i == "x.bin" for i, _ in got)
    assert [tuple(r) for r in readers.resolve_modules(edges, files).collect()] == [("pkg/m.py", "pkg/other.py")]


def test_failures(spark):
    schema = "id int, kind string, error_type string, message string, phase string, module string, operation string, top_frame string"
    e = spark.createDataFrame([(1, "exception", "torch.ValueError", "bad 12", "train", None, None, None)], schema)
    o = spark.createDataFrame([(7, "exception", "ValueError", "bad 99", "train", "m", None, None), (8, "exception", "ValueError", "bad 1", "eval", "m", None, None)], schema)
    assert [tuple(r) for r in failures.matches(e, o).collect()] == [(1, 7)]
    assert failures.groups(o).count() == 2 and failures.groups(o.drop("phase")).first().failures == 2
    df = spark.createDataFrame([("Traceback\n  File x\nmy.KeyError: 'a b'\n",), ("nothing",)], "t string")
    named = spark.createDataFrame([(1, "x", t, "m", None, None, None, None) for t in ("a.TimeoutError", "b.TimeoutError", "TimeoutError", "builtins.TimeoutError")], schema)
    assert sorted((r.error_type, r.failures) for r in failures.groups(named).collect()) == [("TimeoutError", 2), ("a.TimeoutError", 1), ("b.TimeoutError", 1)]
    assert failures.matches(named.limit(1), named).count() == 3

    kind, message = failures.from_traceback(F.col("t"))
    assert [tuple(r) for r in df.select(kind, message).collect()] == [("my.KeyError", "'a b'"), (None, None)]
    df = spark.createDataFrame([('x\n{"failure": {"error_type": "A"}}\n{"failure": {"error_type": "B"}}\n{bad',), ("",)], "t string")
    assert [r.e for r in df.select(failures.last_envelope(F.col("t")).alias("e")).collect()] == ['{"failure": {"error_type": "B"}}', None]
