"""The index of recorded runs, and capsules that are folders, published by renaming with a journal."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .capsules import canonical_json, read_capsule, safe_member, sign, strict_json, write_capsule
from .files import Files, without_credentials

SCHEMA = "seq long, run_id string, capsule string, alias string, status string"


class RunIndex:
    """Runs and aliases as an append-only table: of a run, and of an alias, the latest record counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{without_credentials(root)}/index"

    def _records(self) -> DataFrame:
        there = Files(self.spark, self.path).exists("")
        return self.spark.read.schema(SCHEMA).json(self.path) if there else self.spark.createDataFrame([], SCHEMA)

    def record(self, run_id: str, capsule: str, alias: str | None = None, status: str | None = None) -> None:
        """One more record, by Spark's commit protocol: it is there whole or not at all."""
        row = self.spark.createDataFrame([(time.time_ns(), run_id, capsule, alias, status)], SCHEMA)
        row.coalesce(1).write.mode("append").json(self.path)

    def _latest(self, key: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))
        return self._records().where(F.col(key).isNotNull()).withColumn("rn_", place).where("rn_ = 1").drop("rn_")

    def runs(self) -> DataFrame:
        return self._latest("run_id").select("run_id", "capsule", "status")

    def aliases(self) -> DataFrame:
        return self._latest("alias").select("alias", "run_id")


def publish(files: Files, name: str, run: dict[str, Any], members: dict[str, bytes] | None = None, overwrite: bool = False, key: bytes | None = None) -> None:
    """Write a capsule as a folder: members to a folder of their own, then a journal, then two renames."""
    content = {**(members or {}), "run.json": canonical_json(run).encode()}
    if not all(map(safe_member, content)):
        raise ValueError("a member has an unsafe name")
    if files.exists(name) and not overwrite:
        raise FileExistsError(name)
    content["manifest.json"] = canonical_json({"files": {n: hashlib.sha256(d).hexdigest() for n, d in content.items()}}).encode()
    if key is not None:
        content["signature.json"] = sign(content["manifest.json"], key)
    stage = f".{name}.stage-{uuid.uuid4().hex}"
    for member, data in content.items():
        files.write(f"{stage}/{member}", data)
    files.write(f".{name}.journal", canonical_json({"stage": stage, "old": f".{name}.old"}).encode(), overwrite=True)
    if files.exists(name):
        files.delete(f".{name}.old")
        files.rename(name, f".{name}.old")
    files.rename(stage, name)
    files.delete(f".{name}.old")
    files.delete(f".{name}.journal")


def merge(parent: str, child: str, target: str, run_id: str | None = None) -> None:
    """A capsule with the members of both: the child's where both have one, and what the child's run says of itself."""
    sides = []
    for source in (parent, child):
        rows = list(read_capsule(source))
        if rows[0][7]:
            raise ValueError(f"{source}: {rows[0][7]}")
        sides.append({r[3]: r[6] for r in rows})
    runs = [strict_json(s["run.json"].decode()) for s in sides]
    members = {n: d for s in sides for n, d in s.items() if n not in ("run.json", "manifest.json", "signature.json")}
    write_capsule(target, {**runs[0], **runs[1], "run_id": run_id or runs[1].get("run_id"), "parent_run_id": runs[0].get("run_id")}, members)


def attach_trace(source: str, target: str, analysis: DataFrame, max_rows: int = 10_000) -> dict[str, Any]:
    """A copy of a capsule with what trace.analyse tells of it as failure/tensor_trace.json; returns the counts.

    An analysis is of one run, bounded by its ring; more than max_rows rows are an error.
    """
    rows = [r.asDict() for r in analysis.limit(max_rows + 1).collect()]
    if len(rows) > max_rows:
        raise ValueError(f"the analysis has more than {max_rows} rows")
    held = list(read_capsule(source))
    if held[0][7]:
        raise ValueError(held[0][7])
    members = {r[3]: r[6] for r in held}
    counts = {part: sum(r["part"] == part for r in rows) for part in sorted({r["part"] for r in rows})}
    report = {"rows": sorted(rows, key=lambda r: json.dumps(r, sort_keys=True, default=str)), "counts": counts, "missing_history": counts.get("missing", 0) > 0}
    kept = {n: d for n, d in members.items() if n not in ("run.json", "manifest.json", "signature.json")}
    write_capsule(target, strict_json(members["run.json"].decode()), {**kept, "failure/tensor_trace.json": canonical_json(report).encode()})
    return counts


def _whole(files: Files, folder: str) -> bool:
    try:
        wanted = strict_json(files.read(f"{folder}/manifest.json").decode())["files"]
        there = set(files.names(folder)) - {"manifest.json", "signature.json"}
        return set(wanted) == there and all(hashlib.sha256(files.read(f"{folder}/{n}")).hexdigest() == d for n, d in wanted.items())
    except Exception:  # whatever can't be read isn't whole, in the words of any file system
        return False


def recover(files: Files, name: str) -> str:
    """Bring a publication that broke off to one of its ends: published, finished, restored or discarded."""
    if not files.exists(f".{name}.journal"):
        return "published" if files.exists(name) else "discarded"
    journal = json.loads(files.read(f".{name}.journal"))
    stage, old = journal["stage"], journal["old"]
    if files.exists(name) and _whole(files, name) and not files.exists(stage):
        state = "published"
    elif _whole(files, stage):
        if files.exists(name):
            files.delete(old)
            files.rename(name, old)
        files.rename(stage, name)
        state = "finished"
    elif files.exists(name):
        state = "published"
    elif files.exists(old):
        files.rename(old, name)
        state = "restored"
    else:
        state = "discarded"
    for left in (stage, old, f".{name}.journal"):
        files.delete(left)
    return state
