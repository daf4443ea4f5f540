"""Benchmark decontamination: winnowed fingerprints of both sides are joined and their hits extended to word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_broadcast, drop_rows, ids_and_texts, worker_cache

#: Words in a window, and in one hashed gram. Every window holds WINDOW - GRAM + 1 grams and keeps the smallest
#: hash, so two texts that share WINDOW words keep the same gram there.
WINDOW, GRAM = 10, 5
#: Fingerprints of the benchmark (8 bytes each) up to which a sorted array of them goes to every worker; more are
#: joined with the documents' by a shuffle. Windows and documents with hits up to which their tables are broadcast.
MAX_SEEDS, MAX_BROADCAST_WINDOWS, MAX_BROADCAST_DOCS = 4_000_000, 500_000, 500_000
#: Words whose hash a worker remembers.
CACHE_WORDS = 150_000

WINDOWS = "item string, size int, fp long, h1 long, h2 long"
SCANNED = "doc_id long, sign long, n_words long, hits array<struct<start:int,size:int,h1:long,h2:long>>"


def word_table() -> bytes:
    """A byte map: A-Z become a-z, ASCII other than letters and digits becomes a space."""
    return bytes(c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def _word_cache() -> Any:
    import xxhash

    class Cache(dict):
        def __missing__(self, word: bytes) -> int:
            h = xxhash.xxh64_intdigest(word)
            if len(self) < CACHE_WORDS:
                self[word] = h
            return h

    return Cache()


def _hashes(words: list[bytes]) -> Any:
    import numpy as np

    known = worker_cache("word-hashes", _word_cache, large=True)
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def gram_hashes(hashes: Any, size: int) -> Any:
    """One mixed hash for every run of `size` words."""
    import numpy as np

    n = len(hashes) - size + 1
    if n <= 0:
        return hashes[:0]
    out = hashes[:n].copy()
    for j in range(1, size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[j : j + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def window_minima(grams: Any, width: int) -> Any:
    """The smallest of every `width` neighbouring hashes: the winnowed fingerprint of each window."""
    import numpy as np

    n = len(grams) - width + 1
    if n <= 0:
        return grams[:0]
    out = grams[:n].copy()
    for j in range(1, width):
        np.minimum(out, grams[j : j + n], out=out)
    return out


def marks_of(hashes: Any, size: int, window: int, gram: int) -> Any:
    """For each start of `size` words the hash that stands for it: winnowed, or of a shorter item all of it."""
    if size < window:
        return gram_hashes(hashes, size)
    return window_minima(gram_hashes(hashes, gram), window - gram + 1)


def _window_hash(words: list[bytes], at: int, size: int) -> tuple[int, int]:
    import xxhash

    h = xxhash.xxh3_128_digest(b" ".join(words[at : at + size]))
    return int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)


def _item_windows(window: int, gram: int) -> Any:
    """The windows of benchmark items: size, winnowed fingerprint and 128-bit hash of the words."""

    def run(source: Iterator[Any]) -> Iterator[Any]:
        import numpy as np
        import pyarrow as pa

        table = word_table()
        for batch in source:
            for item, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = raw.translate(table).split()
                size = min(window, len(words))
                if size:
                    prints = np.ascontiguousarray(marks_of(_hashes(words), size, window, gram)).view(np.int64)
                    exact = [_window_hash(words, i, size) for i in range(len(prints))]
                    columns = [pa.array([item] * len(prints)), pa.array([size] * len(prints), type=pa.int32()), pa.array(prints), *(pa.array([h[k] for h in exact], type=pa.int64()) for k in range(2))]
                    yield pa.RecordBatch.from_arrays(columns, names=["item", "size", "fp", "h1", "h2"])

    return run


def _scan(sizes: list[int], seeds: Any, window: int, gram: int) -> Any:
    """Words of each document, and the hashes of its windows whose fingerprint is a seed: seeds of all documents, or
    where that is None the document's own in a fourth column."""

    def run(source: Iterator[Any]) -> Iterator[Any]:
        import numpy as np
        import pyarrow as pa

        table, common = word_table(), None if seeds is None else seeds.value
        kind = pa.struct([("start", pa.int32()), ("size", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])
        for batch in source:
            if not batch.num_rows:
                continue
            own = batch.column(3).to_pylist() if common is None else None
            counts, offsets, found = [], [0], [[], [], [], []]
            for i, raw in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                words = raw.translate(table).split()
                counts.append(len(words))
                mine = common if own is None else {z: np.sort(np.array([m["fp"] for m in own[i] or () if m["size"] == z], dtype=np.int64).view(np.uint64)) for z in sizes}
                hashes = _hashes(words) if own is None or own[i] else None
                for size in sizes if hashes is not None else ():
                    known = mine[size]
                    marks = marks_of(hashes, size, window, gram)
                    if not len(marks) or not len(known):
                        continue
                    runs = np.flatnonzero(np.r_[True, marks[1:] != marks[:-1]])
                    values, ends = marks[runs], np.r_[runs[1:], len(marks)]
                    hit = known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values
                    for start, end in zip(runs[hit].tolist(), ends[hit].tolist(), strict=True):
                        for at in range(start, end):
                            for c, v in zip(found, (at, size, *_window_hash(words, at, size)), strict=True):
                                c.append(v)
                offsets.append(len(found[0]))
            hits = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.StructArray.from_arrays([pa.array(c, type=f.type) for c, f in zip(found, kind, strict=True)], fields=list(kind)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, type=pa.int64()), hits], names=["doc_id", "sign", "n_words", "hits"])

    return run


def _doc_prints(sizes: list[int], window: int, gram: int) -> Any:
    """The different winnowed fingerprints of each document."""

    def run(source: Iterator[Any]) -> Iterator[Any]:
        import numpy as np
        import pyarrow as pa

        table = word_table()
        for batch in source:
            for doc_id, raw, sign in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                hashes = _hashes(raw.translate(table).split())
                for size in sizes:
                    prints = np.unique(marks_of(hashes, size, window, gram)).view(np.int64)
                    if len(prints):
                        yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(prints), type=pa.int64()), pa.array([sign] * len(prints), type=pa.int64()), pa.array([size] * len(prints), type=pa.int32()), pa.array(prints)], names=["doc_id", "sign", "size", "fp"])

    return run


def _contamination(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, gram: int, max_seeds: int) -> DataFrame:
    """contamination, with the text's sign."""
    import numpy as np

    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "decontamination")
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).cast("string").cast("binary").alias("raw")).where("raw IS NOT NULL")
    windows = scratch.write(items.mapInArrow(_item_windows(window, gram), WINDOWS).distinct(), "windows")
    prints = scratch.write(windows.select("size", "fp").distinct(), "prints")
    sizes = sorted(r.size for r in prints.select("size").distinct().collect())
    rows = ids_and_texts(docs, id_col, text_col).withColumn("sign", F.xxhash64("text"))

    if prints.count() <= max_seeds:
        found = prints.toArrow()
        fp, size = found["fp"].to_numpy().view(np.uint64), found["size"].to_numpy()
        seeds = spark.sparkContext.broadcast({z: np.sort(fp[size == z]) for z in sizes})
    else:
        seeds = None
        own = rows.mapInArrow(_doc_prints(sizes, window, gram), "doc_id long, sign long, size int, fp long")
        joined = scratch.write(own.join(prints, ["size", "fp"], "left_semi"), "joined")
        marks = scratch.write(joined.groupBy(F.col("doc_id").alias("own_id"), F.col("sign").alias("own_sign")).agg(F.collect_set(F.struct("size", "fp")).alias("marks")), "marks")
        same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("sign") == F.col("own_sign"))
        rows = rows.join(bounded_broadcast(marks, MAX_BROADCAST_DOCS), same, "left").select("doc_id", "text", "sign", "marks")
    scanned = scratch.write(rows.mapInArrow(_scan(sizes, seeds, window, gram), SCANNED), "scanned")

    exact = ["size", "h1", "h2"]
    hits = scanned.where(F.size("hits") > 0).dropDuplicates(["doc_id", "sign"]).select("doc_id", "sign", F.inline("hits"))
    wanted = scratch.write(windows.select(*exact).distinct(), "wanted")
    matched = scratch.write(hits.join(bounded_broadcast(wanted, MAX_BROADCAST_WINDOWS), exact, "left_semi"), "matched")
    # of windows sorted by their start, each adds the words that lie behind the last one's end
    step = lambda a, w: F.struct((a["n"] + F.greatest(w["end"] - F.greatest(w["start"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], w["end"]).alias("end"))
    spans = F.array_sort(F.collect_set(F.struct(F.col("start"), (F.col("start") + F.col("size")).alias("end"))))
    cover = matched.groupBy("doc_id", "sign").agg(spans.alias("spans"))
    cover = cover.select("doc_id", "sign", F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"].cast("long").alias("n_hit"))
    owners = matched.select("doc_id", "sign", *exact).distinct().join(windows.select(*exact, "item").distinct(), exact).select("doc_id", "sign", "item").distinct()
    owners = owners.groupBy("doc_id", "sign").agg(F.array_sort(F.collect_list("item")).alias("items"))
    both = cover.join(owners, cover["doc_id"].eqNullSafe(owners["doc_id"]) & (cover["sign"] == owners["sign"])).select(cover["doc_id"].alias("hit_id"), cover["sign"].alias("hit_sign"), "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    both = scratch.write(both, "verdicts")
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("sign") == F.col("hit_sign"))
    joined = scanned.drop("hits").join(bounded_broadcast(both, MAX_BROADCAST_DOCS), same, "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select("doc_id", "sign", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. A window is `window` consecutive
    words of a benchmark item, or all of an item with fewer. The winnowed fingerprints of both sides are joined, so
    that no shared window is missed; each hit is extended to the windows around it, whose words are compared by
    128-bit hashes in a second join.

    Up to max_seeds fingerprints, the benchmark's side of the first join is a sorted array in every worker and the
    documents are read once, without a shuffle. Beyond, the documents' fingerprints are shuffled to it, and texts are
    read again. Only windows with a hit and the counts of words are written, never the texts; the second join, by
    which windows find their items, is of those windows alone.

    Null or empty documents have no words; null or empty items have no windows. A null item_id matches like any
    other and is written as "null". Null ids are ids like others, and rows that repeat an id are judged by their own
    text each; repeated rows give repeated results. Empty tables are allowed on either side. Columns other than the
    named ones are not read.
    """
    return _contamination(docs, benchmark, id_col, text_col, item_col, item_text_col, window, gram, max_seeds).drop("sign")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without a hit, with the columns of docs. Nulls, repeats and empty tables as in contamination."""
    found = _contamination(docs, benchmark, id_col, text_col, "item_id", "text", WINDOW, GRAM, MAX_SEEDS)
    gone = Scratch(docs.sparkSession, "contaminated").write(found.where("contaminated").select("doc_id", "sign"), "removed")
    return drop_rows(docs, id_col, text_col, gone)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS words
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
starts AS (
  SELECT doc_id, i, s.size, array_to_string(w[i : i + s.size - 1], ' ') AS words
  FROM d, (SELECT DISTINCT size FROM windows) AS s, unnest(range(1, len(w) - s.size + 2)) AS t(i) WHERE len(w) >= s.size),
found AS (SELECT doc_id, i, size, item_id FROM starts JOIN windows USING (size, words)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + size)) AS t(p) GROUP BY doc_id),
owners AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN owners USING (doc_id)
"""
