"""Line deduplication over range-partitioned, sorted line hashes, giving keep bitmaps instead of text."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batches, ids_and_texts

#: A line counts from this many code points on, and goes if this many documents hold it.
MIN_CHARS, MIN_DOCS = 40, 5
#: Rows and dropped lines up to which the bitmaps' table is broadcast; beyond, documents are shuffled to it.
MAX_BROADCAST_ROWS, MAX_BROADCAST_LINES = 300_000, 4_000_000

LINES = "h1 long, h2 long, doc_id long, sign long, places array<int>"
STREAMED = "kind int, h1 long, h2 long, doc_id long, sign long, places array<int>, n_docs long"
RESULT = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, keep_bitmap binary"
#: What a row of the streamed table says: lines that go, lines not yet decided, a part of a group at a border.
DROP, OPEN, PART = 0, 1, 2


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # of bytes: ASCII white space and letters only


def _line_rows(min_chars: int) -> Any:
    def run(source: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa
        import xxhash

        schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("sign", pa.int64()), ("places", pa.list_(pa.int32()))])
        for batch in source:
            out: list[list[Any]] = [[] for _ in range(5)]
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                places: dict[bytes, list[int]] = {}
                for i, line in enumerate(raw.split(b"\n")):
                    if len(line) >= min_chars:
                        key = line_key(line)
                        if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                            places.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
                if places:
                    sign = xxhash.xxh64_intdigest(raw, 42)
                    sign -= (sign >> 63) << 64
                    for h, at in places.items():
                        for c, v in zip(out, (int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True), doc_id, sign, at), strict=True):
                            c.append(v)
            if out[0]:
                yield from batches(schema, out)

    return run


def _stream(min_docs: int) -> Any:
    """Sorted rows of one range of (hash, largest document first): the first document of a hash stays.

    A hash may begin in an earlier range or go on in a later one; only the first and the last hash of a range can.
    Of those, documents after the first here surely aren't the hash's first; what is not yet sure is left open,
    which is at most min_docs documents, and the range's count and largest document are reported.
    """

    def run(source: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        schema = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("sign", pa.int64()), ("places", pa.list_(pa.int32())), ("n_docs", pa.int64())])
        out: list[list[Any]] = [[] for _ in schema]
        key = top = doc = None
        n_docs, first_run, waiting = 0, True, []

        def put(kind: int, row: tuple, n: int | None = None) -> None:
            for c, v in zip(out, (kind, *row, n), strict=True):
                c.append(v)

        def end(border: bool) -> None:
            if key is not None and (border or first_run):
                put(PART, (*key, top, None, None), n_docs)
                for row in waiting:
                    put(OPEN, row)

        for batch in source:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != key:
                    end(False)
                    first_run, key, top, doc, n_docs, waiting = key is None, row[:2], row[2], row[2], 1, [row]
                    continue
                if row[2] != doc:
                    doc = row[2]
                    n_docs += 1
                    if n_docs == min_docs:  # from here on it is sure that all but the first go
                        for w in waiting:
                            if w[2] != top:
                                put(DROP, w)
                        waiting = [w for w in waiting if w[2] == top]
                if n_docs < min_docs or row[2] == top:
                    waiting.append(row)
                else:
                    put(DROP, row)
            if len(out[0]) >= 50_000:
                yield from batches(schema, out)
                out = [[] for _ in schema]
        end(True)
        if out[0]:
            yield from batches(schema, out)

    return run


def _apply(source: Iterator[Any]) -> Iterator[Any]:
    """Text and dropped places to counts, digest and compressed bitmap (bit i of byte i // 8, most significant first)."""
    import hashlib
    import zlib

    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string()), ("keep_bitmap", pa.binary())])
    for batch in source:
        out: list[list[Any]] = [[] for _ in schema]
        for doc_id, raw, gone in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            n = raw.count(b"\n") + 1
            keep = np.ones(n, dtype=bool)
            if gone:
                keep[np.array(gone)] = False
                raw = b"\n".join(line for line, k in zip(raw.split(b"\n"), keep.tolist(), strict=True) if k)
            row = (doc_id, n, n - int(keep.sum()), hashlib.sha256(raw).hexdigest(), zlib.compress(np.packbits(keep).tobytes(), 1))
            for c, v in zip(out, row, strict=True):
                c.append(v)
        yield from batches(schema, out) if out[0] else ()


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256, keep_bitmap (zlib over packed bits).

    A line's key is the line without ASCII white space at both ends and with A-Z lower-cased. Keys of at least
    min_chars code points in at least min_docs documents lose all their lines except in the largest doc_id that
    holds them. Each document sends one row per different key with the places of its lines; rows are partitioned
    by ranges of (hash, document), so the documents of one very common line spread over many tasks.

    Null and empty texts have one empty line. A null doc_id is a document smaller than all others. Rows that
    repeat a doc_id are one document when documents are counted, and each keeps its own lines. If every line goes,
    the kept text is empty. An empty table gives an empty result. Other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "lines")
    docs = ids_and_texts(df, id_col, text_col)
    rows = scratch.write(docs.mapInArrow(_line_rows(min_chars), LINES), "lines")
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last()]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    streamed = scratch.write(sorted_rows.mapInArrow(_stream(min_docs), STREAMED), "streamed")
    scratch.drop("lines")
    groups = streamed.where(F.col("kind") == PART).groupBy("h1", "h2").agg(F.sum("n_docs").alias("docs"), F.max("doc_id").alias("top")).where(F.col("docs") >= min_docs)
    late = streamed.where(F.col("kind") == OPEN).join(groups, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("top")))
    gone = streamed.where(F.col("kind") == DROP).select("doc_id", "sign", "places").unionByName(late.select("doc_id", "sign", "places"))
    by_doc = scratch.write(gone.groupBy(F.col("doc_id").alias("gone_id"), F.col("sign").alias("gone_sign")).agg(F.flatten(F.collect_set("places")).alias("gone")), "gone")
    n, lines = by_doc.agg(F.count(F.lit(1)), F.sum(F.size("gone"))).first()
    few = n <= max_broadcast_rows and (lines or 0) <= MAX_BROADCAST_LINES
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_sign"))
    return docs.join(F.broadcast(by_doc) if few else by_doc, same, "left").select("doc_id", "text", "gone").mapInArrow(_apply, RESULT)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("keep_bitmap")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i] AS line,
             translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM d, unnest(range(1, len(lines) + 1)) AS t(i)),
k AS (SELECT key, max(doc_id) AS top FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.doc_id, l.i, l.line, k.top IS NOT NULL AND k.top <> l.doc_id AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
