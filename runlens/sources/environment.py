"""What a run was made with, as rows: interpreter, packages, variables, hardware, version control, installed readers."""

from __future__ import annotations

import json
import os
import platform
import subprocess
import sys
from collections.abc import Mapping, Sequence
from importlib import metadata
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.redaction import REDACTED, names_secret
from .files import Files

FACTS = "section string, name string, value string"


def environment(spark: SparkSession, allowed: Sequence[str] = (), environ: Mapping[str, str] | None = None) -> DataFrame:
    """section, name, value: interpreter, packages, Spark and the allowed variables, those named like secrets hidden."""
    env = os.environ if environ is None else environ
    facts = [("interpreter", "version", platform.python_version()), ("interpreter", "executable", sys.executable), ("spark", "version", spark.version)]
    facts += sorted({("package", d.metadata["Name"], d.version) for d in metadata.distributions() if d.metadata["Name"]})
    facts += [("variable", n, REDACTED if names_secret(n) else env[n]) for n in sorted(allowed) if n in env]
    return spark.createDataFrame(facts, FACTS)


def system(spark: SparkSession) -> DataFrame:
    """section, name, value: machine, processors, memory of the driver, and the cluster's cores."""
    pages = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") if hasattr(os, "sysconf") else 0
    facts = [("machine", "system", platform.system()), ("machine", "architecture", platform.machine()), ("machine", "processors", str(os.cpu_count())), ("machine", "memory_bytes", str(pages)), ("cluster", "parallelism", str(spark.sparkContext.defaultParallelism))]
    return spark.createDataFrame(facts, FACTS)


def version_control(spark: SparkSession, path: str = ".", max_diff: int = 250_000) -> DataFrame:
    """section, name, value: commit, branch and the difference to it of a checkout; nothing outside of one.

    The difference is cut at max_diff characters, and `diff_cut` says whether it was.
    """

    def git(*words: str) -> str | None:
        got = subprocess.run(["git", "-C", path, *words], capture_output=True, text=True, check=False)
        return got.stdout.strip("\n") if got.returncode == 0 else None

    commit = git("rev-parse", "HEAD")
    diff = git("diff", "HEAD") or "" if commit else ""
    facts = [] if commit is None else [("git", "commit", commit), ("git", "branch", git("rev-parse", "--abbrev-ref", "HEAD")), ("git", "diff", diff[:max_diff]), ("git", "diff_cut", str(len(diff) > max_diff).lower())]
    return spark.createDataFrame(facts, FACTS)


def installed(group: str, found: Sequence[Any] | None = None) -> list[tuple[str, Any]]:
    """(name, object) of installed entry points of a group, by name; one that can't be loaded is left out."""
    out = []
    for point in sorted(metadata.entry_points(group=group) if found is None else found, key=lambda p: p.name):
        try:
            out.append((point.name, point.load()))
        except Exception:  # somebody else's package may fail in any way
            continue
    return out


def write_result(files: Files, name: str, result: Mapping[str, Any]) -> None:
    """A child's result as strict JSON, there whole or not at all."""
    text = json.dumps(dict(result), sort_keys=True, allow_nan=False, indent=2) + "\n"
    files.write(f".{name}.part", text.encode(), overwrite=True)
    files.delete(name)
    files.rename(f".{name}.part", name)


def read_result(files: Files, name: str) -> dict[str, Any]:
    from .capsules import strict_json

    return strict_json(files.read(name).decode())
