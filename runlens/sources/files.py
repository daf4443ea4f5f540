"""Small files on any file system: by the driver through Hadoop's, by workers through pyarrow's; configuration, samples."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a sample.
SAMPLE_ROWS = 128
#: Sections of a configuration file and their keys; None allows any.
SECTIONS: dict[str, set[str] | None] = {
    "storage": {"root", "backend", "uri"},
    "tracking": {"backend", "uri", "experiment", "project"},
    "lineage": {"backend", "uri"},
    "impact": None,
    "ci": {"confidence", "fail_on_regression", "fail_on_failed_run", "fail_on_nonfinite", "fail_on_missing_evidence", "fail_on_behavior_regression", "fail_on_parity_failure", "thresholds", "required_metrics", "required_resources", "min_sample_count", "min_slice_support", "behavior_threshold", "calibration_threshold", "higher_is_better", "noninferiority_margins", "required_evidence"},
}


def worker_filesystem(uri: str) -> tuple[Any, str]:
    """A pyarrow file system and the path in it, for code that runs without a JVM."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else re.sub("^file:", "", uri, count=1))


def without_credentials(uri: str) -> str:
    if re.search(r"://[^/@]*@", uri):
        raise ValueError("an address may not hold credentials; set them in the cluster's configuration")
    return uri.rstrip("/")


class Files:
    """A folder of small files on any file system that the cluster's Hadoop configuration knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self._jvm = without_credentials(root), spark._jvm
        self._fs = spark._jvm.org.apache.hadoop.fs.FileSystem.newInstance(self._path("").toUri(), spark._jsc.hadoopConfiguration())
        self._fs.setWriteChecksum(False)  # no further files beside ours; this instance is nobody else's

    def _path(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes, overwrite: bool = False) -> None:
        stream = self._fs.create(self._path(name), overwrite)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> None:
        target = self._path(new)
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(self._path(old), target):
            raise FileExistsError(f"{self.root}/{new}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def names(self, name: str = "") -> list[str]:
        """All files below a folder, as sorted paths relative to it."""
        top = self._path(name)
        if not self._fs.exists(top):
            return []
        found, start, out = self._fs.listFiles(top, True), len(self._fs.makeQualified(top).toString()) + 1, []
        while found.hasNext():
            out.append(found.next().getPath().toString()[start:])
        return sorted(n for n in out if not n.endswith(".crc"))


def restore(files: Files, trash: str, destination: str, overwrite: bool = False) -> None:
    """Bring a collected file back; an existing destination stays unless it may be overwritten."""
    if not files.exists(trash):
        raise FileNotFoundError(trash)
    if files.exists(destination):
        if not overwrite:
            raise FileExistsError(destination)
        files.delete(destination)
    files.rename(trash, destination)


def safe_key(key: Column) -> Column:
    """A key with forward slashes if it is relative and has no empty, . or .. steps; else null."""
    plain = F.replace(key, F.lit("\\"), F.lit("/"))
    odd = (F.trim(key) == "") | F.contains(plain, F.lit("\x00")) | plain.rlike(r"(^|/)(\.{0,2})(/|$)")
    return F.when(~odd, plain)


def load_config(text: str) -> dict[str, Any]:
    """A TOML configuration; sections and keys that nobody reads are an error rather than ignored."""
    import tomllib

    found = tomllib.loads(text)
    unknown = sorted(set(found) - set(SECTIONS))
    unknown += sorted(f"{s}.{k}" for s, allowed in SECTIONS.items() if allowed is not None and isinstance(found.get(s), Mapping) for k in set(found[s]) - allowed)
    unknown += sorted(s for s in SECTIONS if s in found and not isinstance(found[s], Mapping))
    if unknown:
        raise ValueError(f"not known in a configuration: {', '.join(unknown)}")
    return found


def sample_rows(spark: SparkSession, path: str, rows: int = SAMPLE_ROWS) -> DataFrame | None:
    """The first rows of a CSV, JSON-lines or JSON file, all columns as text or as JSON gives them; None for others."""
    ending = path.lower().rpartition(".")[2]
    if ending == "csv":
        return spark.read.option("header", "true").csv(path).limit(rows)
    if ending in ("jsonl", "ndjson", "json"):
        return spark.read.option("multiLine", "true" if ending == "json" else "false").json(path).limit(rows)
    return None


def schema_sample(df: DataFrame, order: list[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """column, type, nulls of the first rows in an order of the caller's."""
    from ..operators.tables import schema_profile

    return schema_profile(df.orderBy(*order).limit(rows)).select("column", "type", "nulls")


def as_table(spark: SparkSession, value: Any, columns: list[str] | None = None) -> DataFrame:
    """A DataFrame of a DataFrame, a pandas or Arrow table, a mapping of columns, records, rows or one value."""
    if isinstance(value, DataFrame):
        return value.select(*columns) if columns else value
    if isinstance(value, Mapping):
        lists = {k: v if isinstance(v, list | tuple) else [v] for k, v in value.items()}
        names = columns or list(lists)
        return spark.createDataFrame(list(zip(*(lists[c] for c in names), strict=True)), names)
    if hasattr(value, "columns") and not isinstance(value, list | tuple):
        made = spark.createDataFrame(value)
        return made.select(*columns) if columns else made
    if isinstance(value, list | tuple) and value and isinstance(value[0], Mapping):
        names = columns or list(dict.fromkeys(k for r in value for k in r))
        return spark.createDataFrame([tuple(r.get(c) for c in names) for r in value], names)
    rows = [tuple(r) if isinstance(r, list | tuple) else (r,) for r in (value if isinstance(value, list | tuple) else [value])]
    return spark.createDataFrame(rows, columns or [f"column_{i}" for i in range(len(rows[0]))])
