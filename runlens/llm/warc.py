"""WARC archives of web pages with a Zstandard dictionary in a leading skippable frame, one frame per record."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batches, filesystem, small_batches

#: Payloads of at least so many bytes are stored once; later equal ones refer to it.
MIN_REVISIT_BYTES = 1000
#: The dictionary is trained on about so many records (twice as many at most) of at most so many bytes, chosen by a
#: hash of the identifier.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 32_768, 65_536
#: An archive is closed and another begun beyond so many bytes.
MAX_ARCHIVE_BYTES = 1 << 30
#: Groups of equal payloads up to which their table is broadcast; beyond, pages are shuffled to it.
MAX_BROADCAST_GROUPS = 300_000

SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records long, n_bytes long"
#: Headers of our own: the identifier of a page, and of the page that a revisit refers to.
PAGE, FIRST_PAGE = "Runlens-Page-ID", "Runlens-Refers-To-Page-ID"
RESULT = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, whole boolean"


def record_uri(namespace: uuid.UUID, name: str) -> str:
    """A name-based identifier of a record."""
    return uuid.uuid5(namespace, name).urn


def _page_text(page_id: int | None) -> str:
    return "null" if page_id is None else str(page_id)


def page_of(text: str) -> int | None:
    return None if text == "null" else int(text)


def _base32(digest: str) -> str:
    import base64

    return base64.b32encode(bytes.fromhex(digest)).decode()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _address(url: str | None) -> str:
    return "".join(c if c.isprintable() and not c.isspace() else "%20" for c in url or "about:blank")


def make_record(uri: str, page_id: int | None, url: str | None, payload: bytes, digest: str, date: str, first: Any = None) -> bytes:
    """A response record with its HTTP head and payload; with `first` (page, url, uri or None) a revisit record with
    the head alone, which names the first page's address, date and, where it has just one record, that record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", f"<{uri}>"), (PAGE, _page_text(page_id)), ("WARC-Target-URI", _address(url)), ("WARC-Date", date)]
    if first:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", _address(first[1])), ("WARC-Refers-To-Date", date), (FIRST_PAGE, _page_text(first[0]))]
        headers += [("WARC-Refers-To", f"<{first[2]}>")] if first[2] else []
    headers += [("WARC-Payload-Digest", f"sha1:{_base32(digest)}"), ("Content-Type", "application/http; msgtype=response")]
    return _record(headers, http if first else http + payload)


def train_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; where there is too little to train on, the records themselves serve as content."""
    import zstandard

    if len(records) >= 16:
        try:
            return zstandard.train_dictionary(size, records).as_bytes()
        except zstandard.ZstdError:
            pass
    return (b"".join(records) or make_record("urn:uuid:0", 0, "http://example.com/", b"<html></html>", "0" * 40, "2024-01-01T00:00:00Z"))[:size]


class ArchiveWriter:
    """Streams records to a file: the dictionary in a skippable frame, then each record as a frame of its own."""

    def __init__(self, sink: Any, dictionary: bytes, name: str = "archive", date: str = "2024-01-01T00:00:00Z", level: int = 3):
        import zstandard

        self.sink, self.size, self.records = sink, 0, 0
        held = zstandard.ZstdCompressionDict(dictionary)
        held.precompute_compress(level=level)
        self.packer = zstandard.ZstdCompressor(dict_data=held, level=level, write_checksum=True)
        packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
        self._put(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        self.add(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{record_uri(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: runlens\r\nformat: WARC File Format 1.1\r\n"))
        self.records = 0

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.size += len(data)

    def add(self, record: bytes) -> None:
        self._put(self.packer.compress(record))
        self.records += 1


def read_archive(source: Any, step: int = 1 << 14) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record after the info record, reading a little at a time."""
    import zstandard

    magic, length = struct.unpack("<II", source.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    dictionary = zstandard.ZstdDecompressor().decompress(source.read(length))
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    rest = b""
    while True:
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            data, rest = rest or source.read(step), b""
            if not data:
                if parts:
                    raise ValueError("the archive ends inside a record")
                return
            parts.append(frame.decompress(data))
            rest = frame.unused_data
        head, _, body = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1" or body[-4:] != b"\r\n\r\n":
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        if int(headers["Content-Length"]) != len(body) - 4:
            raise ValueError("a record's length is wrong")
        if headers["WARC-Type"] != "warcinfo":
            yield headers, body[:-4]


def _writer(folder: str, dictionary: bytes, date: str, limit: int) -> Any:
    def run(source: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        namespace = uuid.uuid5(uuid.NAMESPACE_URL, folder)

        fs, base = filesystem(folder)
        schema = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])
        out = sink = None
        done: list[list[Any]] = [[], [], []]

        def close() -> None:
            sink.close()
            for c, v in zip(done, (f"{folder}/{name}", out.records, out.size), strict=True):
                c.append(v)

        for batch in source:
            ids, urls, bodies, *rest = (batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), *(batch.column(i).to_pylist() for i in range(3, 7)))
            for page_id, url, body, digest, target, target_url, target_rows in zip(ids, urls, bodies, *rest, strict=True):
                if out is None:  # a name of its own for each attempt: only what a finished task reports is read
                    fs.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    sink = fs.open_output_stream(f"{base}/{name}")
                    out = ArchiveWriter(sink, dictionary, name, date)
                named = record_uri(namespace, f"{target}/{digest}") if target is not None and target_rows == 1 else None
                if target is not None and target != page_id:
                    out.add(make_record(record_uri(namespace, f"{name}/{out.records}"), page_id, url, body, digest, date, (target, target_url, named)))
                else:
                    out.add(make_record(named or record_uri(namespace, f"{name}/{out.records}"), page_id, url, body, digest, date))
                if out.size >= limit:
                    close()
                    out = None
        if out is not None:
            close()
        if done[0]:
            yield from batches(schema, done)

    return run


def _read(source: Iterator[Any]) -> Iterator[Any]:
    import base64
    import hashlib

    import pyarrow as pa

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("whole", pa.bool_())])
    for batch in source:
        for path in batch.column(0).to_pylist():
            fs, base = filesystem(path)
            with fs.open_input_stream(base) as file:
                out: list[list[Any]] = [[] for _ in schema]
                for headers, block in read_archive(file):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(head.rpartition(b"Content-Length: ")[2])
                    digest = base64.b32decode(headers["WARC-Payload-Digest"][5:]).hex()
                    response = headers["WARC-Type"] == "response"
                    whole = not response or (len(payload) == size and hashlib.sha1(payload).hexdigest() == digest)
                    target = None if response else page_of(headers[FIRST_PAGE])
                    for c, v in zip(out, (page_of(headers[PAGE]), headers["WARC-Target-URI"], size, digest, headers["WARC-Type"], target, whole), strict=True):
                        c.append(v)
                    if len(out[0]) >= 8192:
                        yield from batches(schema, out)
                        out = [[] for _ in schema]
                if out[0]:
                    yield from batches(schema, out)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES, folder: str | None = None, date: str | None = None, max_archive_bytes: int = MAX_ARCHIVE_BYTES, max_broadcast_groups: int = MAX_BROADCAST_GROUPS) -> DataFrame:
    """Write the archives and return their manifest: path, n_records, n_bytes.

    Of pages whose payloads (html in UTF-8) are equal and have at least min_bytes bytes, that with the largest
    identifier is a response record and the others revisit it; all smaller ones are responses. Equal payloads are
    found by their SHA-256, counted before the shuffle; their table is broadcast up to a bound and joined by a
    shuffle beyond it, in which smaller pages take no part. Records have identifiers of their own, the page's in a
    header; their date is that of the run unless given. Each task streams its pages to archives of its own in the shared folder, all with one
    dictionary, trained on a bounded sample of records.

    Null html is an empty payload, a null url is about:blank, and a null identifier is written as null (smaller
    than others). Rows that repeat the largest identifier are all
    responses, and revisits then name its address and date but no single record. An empty table writes nothing. Other
    columns are not read.
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "warc")
    small_batches(spark)
    folder, date = folder or f"{scratch.path}/files", date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha1("html"), "key": F.when(F.octet_length("html") >= min_bytes, F.unhex(F.sha2("html", 256)))})
    per_page = rows.where("key IS NOT NULL").groupBy("key", "page_id").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("url"))
    groups = per_page.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "n", "url"))).alias("top")).where("all > 1 AND top IS NOT NULL")
    groups = scratch.write(groups.select("key", F.col("top.page_id").alias("target"), F.col("top.url").alias("target_url"), F.col("top.n").alias("target_rows")), "groups")
    columns = ["page_id", "url", "html", "digest", "target", "target_url", "target_rows"]
    if groups.count() <= max_broadcast_groups:
        marked = rows.join(F.broadcast(groups), "key", "left").select(*columns)
    else:
        small = rows.where("key IS NULL").select(*columns[:4], F.lit(None).cast("long").alias("target"), F.lit(None).cast("string").alias("target_url"), F.lit(None).cast("long").alias("target_rows"))
        marked = rows.where("key IS NOT NULL").join(groups, "key", "left").select(*columns).unionByName(small)
    usable = rows.where(F.octet_length("html") <= SAMPLE_BYTES)
    share = min(1.0, 1.3 * SAMPLE_RECORDS / max(1, pages.count()))
    sample = usable.where(F.pmod(F.xxhash64("page_id", F.lit("sample")), F.lit(10**9)) <= int(10**9 * share)).limit(2 * SAMPLE_RECORDS)
    dictionary = train_dictionary([make_record(record_uri(uuid.NAMESPACE_URL, str(r.page_id)), r.page_id, r.url, r.html.encode(), r.digest, date) for r in sample.select("page_id", "url", "html", "digest").collect()])
    return scratch.write(marked.mapInArrow(_writer(folder, dictionary, date, max_archive_bytes), MANIFEST), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and whole (the stored payload has its
    length and digest) of every record, from the files; one task per archive."""
    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(_read, RESULT)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))).drop("url")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, html, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND top <> page_id THEN top END AS refers_to, true AS whole
FROM q
"""
