"""Capsules: a run's evidence as a directory or ZIP of JSON with a manifest of digests.

`register` makes spark.read.format("capsule") available: one partition per capsule, members checked against the
manifest while reading. Layout: run.json, manifest.json ({"files": {name: sha256}}) and any further members.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import Files, worker_filesystem

#: A capsule may hold so many bytes and members at most.
MAX_BYTES, MAX_MEMBERS = 20 << 30, 100_000
#: The version of run.json that is read and written.
VERSION = 1
SCHEMA = "capsule string, run_id string, status string, member string, size long, sha256 string, content binary, error string"


def safe_member(name: str) -> bool:
    """A relative path without parent steps, backslashes or NUL."""
    return bool(name) and not name.startswith("/") and "\\" not in name and "\0" not in name and ".." not in name.split("/") and not re.match(r"^[A-Za-z]:", name)


def strict_json(text: str) -> Any:
    """JSON without repeated keys and without NaN or infinities."""

    def pairs(items: list[tuple[str, Any]]) -> dict[str, Any]:
        if len({k for k, _ in items}) != len(items):
            raise ValueError("a key occurs twice")
        return dict(items)

    def constant(name: str) -> Any:
        raise ValueError(f"{name} is not JSON")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def sign(manifest: bytes, key: bytes) -> bytes:
    """The content of a capsule's signature.json."""
    return canonical_json({"algorithm": "hmac-sha256", "value": hmac.new(key, manifest, hashlib.sha256).hexdigest()}).encode()


#: Steps from one version of run.json to the next, by the version that they start from.
MIGRATIONS: dict[int, Callable[[dict[str, Any]], dict[str, Any]]] = {}


def migrated(run: dict[str, Any], version: int = VERSION) -> dict[str, Any]:
    """run.json at the version that is read here; a newer one, or one that no step leads from, is an error."""
    now = int(run.get("schema_version", version))
    if now > version:
        raise ValueError(f"run.json has version {now}, and {version} is the newest that is read")
    while now < version:
        if now not in MIGRATIONS:
            raise ValueError(f"nothing leads on from version {now} of run.json")
        run, now = MIGRATIONS[now](run), now + 1
    return run


class _Capsule:
    """The members of a folder or a ZIP file, each opened on its own."""

    def __init__(self, uri: str):
        self.fs, self.base = worker_filesystem(uri)
        from pyarrow import fs

        if self.fs.get_file_info(self.base).type == fs.FileType.Directory:
            found = self.fs.get_file_info(fs.FileSelector(self.base, recursive=True))
            self.sizes = {f.path[len(self.base.rstrip("/")) + 1 :]: f.size for f in found if f.type == fs.FileType.File}
            self.archive = None
        else:
            self.archive = zipfile.ZipFile(self.fs.open_input_file(self.base))
            self.sizes = {i.filename: i.file_size for i in self.archive.infolist() if not i.is_dir()}
            if len(self.sizes) != sum(not i.is_dir() for i in self.archive.infolist()):
                raise ValueError("a member occurs twice")
        if len(self.sizes) > MAX_MEMBERS or sum(self.sizes.values()) > MAX_BYTES:
            raise ValueError("the capsule is too large")
        if not all(map(safe_member, self.sizes)):
            raise ValueError("a member has an unsafe name")

    def open(self, name: str) -> Any:
        return self.archive.open(name) if self.archive else self.fs.open_input_stream(f"{self.base.rstrip('/')}/{name}")

    def read(self, name: str) -> bytes:
        with self.open(name) as file:
            return file.read(self.sizes[name] + 1)

    def digest(self, name: str) -> str:
        h, left = hashlib.sha256(), self.sizes[name]
        with self.open(name) as file:
            while part := file.read(1 << 20):
                h.update(part)
                left -= len(part)
                if left < 0:  # what an archive says of a member needn't be true
                    raise ValueError("a member is longer than it says")
        return h.hexdigest()


def read_capsule(path: str, members: Sequence[str] | None = None, max_file_bytes: int | None = None, key: bytes | None = None, require_signature: bool = False) -> Iterator[tuple]:
    """Rows of one capsule; a capsule that can't be read or checked gives one row with its error.

    Every member is hashed in small parts and checked against the manifest before the first row is given. Contents are
    read one by one, those of `members` only if given and none beyond max_file_bytes: the others have a row without.
    With a key the signature of the manifest is checked, if there is one or one is required.
    """
    try:
        held = _Capsule(path)
        raw = held.read("manifest.json")
        manifest = strict_json(raw.decode())["files"]
        there = {n: held.digest(n) for n in sorted(held.sizes) if n not in ("manifest.json", "signature.json")}
        if manifest != there:
            raise ValueError("members differ from the manifest")
        signed = "signature.json" in held.sizes
        if require_signature and not (signed and key):
            raise ValueError("the capsule isn't signed, or there is no key")
        if signed and key and not hmac.compare_digest(held.read("signature.json"), sign(raw, key)):
            raise ValueError("the signature is wrong")
        run = migrated(strict_json(held.read("run.json").decode()))
    except (OSError, ValueError, KeyError, zipfile.BadZipFile) as e:
        yield path, None, None, None, None, None, None, f"{type(e).__name__}: {e}"
        return
    for name in sorted(held.sizes):
        wanted = (members is None or name in members) and (max_file_bytes is None or held.sizes[name] <= max_file_bytes)
        yield path, run.get("run_id"), run.get("status"), name, held.sizes[name], there.get(name), held.read(name) if wanted else None, None


def write_capsule(path: str, run: dict[str, Any], members: dict[str, bytes] | None = None, overwrite: bool = True, key: bytes | None = None) -> None:
    """A deterministic ZIP: sorted names, fixed times, a manifest of digests; published by renaming."""
    files = {**(members or {}), "run.json": canonical_json(run).encode()}
    if not all(map(safe_member, files)):
        raise ValueError("a member has an unsafe name")
    files["manifest.json"] = canonical_json({"files": {n: hashlib.sha256(d).hexdigest() for n, d in files.items()}}).encode()
    if key is not None:
        files["signature.json"] = sign(files["manifest.json"], key)
    fs, target = worker_filesystem(path)
    if not overwrite and fs.get_file_info(target).type.name != "NotFound":
        raise FileExistsError(path)
    with fs.open_output_stream(target + ".part") as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as archive:
        for name in sorted(files):
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), files[name])
    fs.move(target + ".part", target)


#: The files that a capsule shows its evidence in, and where in the run or the evidence it stands.
VIEWS = {
    "code.json": ("code", "git"),
    "environment.json": ("environment",),
    "hardware.json": ("hardware",),
    "dependencies.json": ("dependencies",),
    "data/fingerprints.json": ("data.fingerprints",),
    "data/schema.json": ("data.schema",),
    "training/metrics.json": ("metrics",),
    "training/observations.json": ("observations",),
    "training/events.jsonl": ("events",),
    "model/signature.json": ("models",),
    "system/resource_trace.json": ("resources",),
    "failure/exception.json": ("failure_signature",),
    "failure/tensor_trace.json": ("tensor_trace",),
    "replay/inputs.json": ("replay.input",),
    "replay/state.json": ("replay.state",),
    "replay/checkpoints.json": ("replay.checkpoints",),
    "replay/last_checkpoint.json": ("replay.last_checkpoint",),
    "replay/plan.json": ("replay_plan",),
}


def structured_files(run: dict[str, Any], evidence: dict[str, Any] | None = None) -> dict[str, bytes]:
    """The members that show a run's evidence section by section; empty sections have none."""
    metadata = run.get("metadata") or {}

    def at(path: str) -> Any:
        for top in (evidence or {}, run, metadata):
            now: Any = top
            for step in path.split("."):
                now = now.get(step) if isinstance(now, dict) else None
            if now not in (None, {}, [], ()):
                return now
        return None

    out = {}
    for name, places in VIEWS.items():
        found = next((v for v in map(at, places) if v is not None), None)
        if found is not None:
            out[name] = b"".join(canonical_json(x).encode() + b"\n" for x in found) if name.endswith(".jsonl") else canonical_json(found).encode()
    return out


class _Partition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class CapsuleReader(DataSourceReader):
    """Options: path (a capsule or a folder of them), members (comma-separated), maxFileBytes, key, requireSignature."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        members = options.get("members")
        self.options = {
            "members": [m.strip() for m in members.split(",")] if members else None,
            "max_file_bytes": int(options["maxFileBytes"]) if "maxFileBytes" in options else None,
            "key": options["key"].encode() if "key" in options else None,
            "require_signature": options.get("requireSignature", "false").lower() == "true",
        }

    def partitions(self) -> list[_Partition]:
        from pyarrow import fs as pafs

        fs, base = worker_filesystem(self.root)
        there = lambda p: fs.get_file_info(p).type
        if there(base) == pafs.FileType.File or there(f"{base}/manifest.json") == pafs.FileType.File:
            return [_Partition(self.root)]
        entries = [(f.path, f.type) for f in fs.get_file_info(pafs.FileSelector(base))]
        found = sorted(p for p, kind in entries if (kind == pafs.FileType.File and p.endswith(".zip")) or (kind == pafs.FileType.Directory and there(f"{p}/manifest.json") == pafs.FileType.File))
        return [_Partition(f"{self.root}/{p.rsplit('/', 1)[-1]}") for p in found] or [_Partition("")]

    def read(self, partition: _Partition) -> Iterator[tuple]:
        if partition.path:
            yield from read_capsule(partition.path, **self.options)


class CapsuleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capsule"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> CapsuleReader:
        return CapsuleReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CapsuleSource)


def run_index(members: DataFrame) -> DataFrame:
    """run_id, capsule, status of readable capsules."""
    return members.where("error IS NULL AND member = 'run.json'").select("run_id", "capsule", "status")


def resolve(index: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """The capsule of a run id, a path or an alias."""
    named = aliases.where(F.col("alias") == name).select("run_id")
    return index.where((F.col("run_id") == name) | (F.col("capsule") == name)).unionByName(index.join(named, "run_id", "left_semi")).distinct()


def directory_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """files, sha256 over the sorted (relative path, file digest) records; the place of the directory doesn't count.

    Files are hashed where they are read; the records of one directory, at most MAX_MEMBERS of them, meet in one row.
    """
    root = Files(spark, path)
    start = root._fs.makeQualified(root._path("")).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    relative = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "file:/"), "^" + re.escape(re.sub(r"^file:/+", "file:/", start)) + "/?", "")
    record = F.struct(relative.alias("path"), F.sha2("content", 256).alias("sha256"))
    out = files.select(record.alias("r")).agg(F.count(F.lit(1)).alias("files"), F.sha2(F.to_json(F.array_sort(F.collect_list("r"))), 256).alias("sha256"))
    return out.select(F.when(F.col("files") <= MAX_MEMBERS, F.col("files")).otherwise(F.raise_error(F.lit("the directory has too many files"))).alias("files"), "sha256")


def dataset_fingerprint(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """files, sha256 of several directories; their order doesn't count."""
    each = [directory_fingerprint(spark, p) for p in paths]
    both = each[0]
    for other in each[1:]:
        both = both.unionByName(other)
    return both.agg(F.sum("files").alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ","), 256).alias("sha256"))


def put_content(df: DataFrame, content: str = "content", keep: Sequence[str] = ()) -> DataFrame:
    """sha256, key (sha256/ab/digest), content: one row per different content, for a content-addressed store."""
    h = F.sha2(content, 256)
    return df.select(h.alias("sha256"), F.concat_ws("/", F.lit("sha256"), F.substring(h, 1, 2), h).alias("key"), content, *keep).dropDuplicates(["sha256"])


def verify_content(df: DataFrame, digest: str = "sha256", content: str = "content") -> DataFrame:
    return df.withColumn("intact", F.sha2(content, 256) == F.col(digest))
