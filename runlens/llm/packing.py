"""Hierarchical residual packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batches, ids_and_texts
from .tokens import default_tokenizer, encoder, text_groups

#: A bin with at most this much room is full and takes no further part.
SLACK = 2
#: Rows (pieces) that one packing task holds at most.
MAX_ROWS = 400_000

#: The share of bins left after a round from which on it counts as stalled, and the round from which on all do (round
#: numbers have eight bits of a sequence's number).
STALLED, MOST_ROUNDS = 0.95, 150

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, room int"


def best_fit(sizes: Any, capacity: int) -> tuple[Any, Any, Any]:
    """Best-fit decreasing: for each item its bin and its place there, and the room left in each bin.

    Bins with room are kept by their room; a bit mask of the rooms in use finds the tightest fit in one step.
    """
    import numpy as np

    order = np.argsort(-sizes, kind="stable").tolist()
    listed = sizes.tolist()
    to_bin, place, room = [0] * len(listed), [0] * len(listed), []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in order:
        size = listed[i]
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = open_bins[free].pop()
            if not open_bins[free]:
                mask ^= 1 << free
        else:
            b, free = len(room), capacity
            room.append(capacity)
        to_bin[i], place[i] = b, capacity - free
        free -= size
        room[b] = free
        if free:
            open_bins[free].append(b)
            mask |= 1 << free
    return np.array(to_bin, dtype=np.int64), np.array(place, dtype=np.int64), np.array(room, dtype=np.int64)


def _arrow_schema() -> Any:
    import pyarrow as pa

    return pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("room", pa.int32())])


def _bin_ids(round_no: int, n: int, seen: int) -> Any:
    import numpy as np
    from pyspark import TaskContext

    return (round_no << 55) + (TaskContext.get().partitionId() << 32) + seen + np.arange(n, dtype=np.int64)


def _packer(path: str, capacity: int, end_id: int, max_rows: int) -> Any:
    """Round 0: tokenise, cut, and pack what this task reads."""

    def run(source: Iterator[Any]) -> Iterator[Any]:
        import zlib

        import numpy as np

        schema, made, full = _arrow_schema(), encoder(path), capacity * 4
        end = int(end_id).to_bytes(4, "little")
        cols: list[list[Any]] = [[] for _ in range(5)]
        seen = 0

        def flush() -> Iterator[Any]:
            nonlocal cols, seen
            sizes = np.array(cols[3], dtype=np.int64)
            to_bin, place, room = best_fit(sizes, capacity)
            ids = _bin_ids(0, len(room), seen)
            seen += len(room)
            yield from batches(schema, [*cols, ids[to_bin], place, room[to_bin]])
            cols = [[] for _ in range(5)]

        for batch in source:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for group in text_groups(texts):
                for i, raw in zip(group, made.encode_many([texts[i] for i in group]), strict=True):
                    raw += end
                    for piece, at in enumerate(range(0, len(raw), full)):
                        part = raw[at : at + full]
                        for c, v in zip(cols, (keys[i], piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            c.append(v)
            if len(cols[0]) >= max_rows:
                yield from flush()
        if cols[0]:
            yield from flush()

    return run


def _merger(round_no: int, capacity: int) -> Any:
    """Later rounds: the bins that reach this task are items, packed again."""

    def run(source: Iterator[Any]) -> Iterator[Any]:
        import numpy as np
        import pyarrow as pa

        schema = _arrow_schema()
        got = [b for b in source if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        old, first, item = np.unique(t["sequence_id"].to_numpy(), return_index=True, return_inverse=True)
        used = capacity - t["room"].to_numpy()[first].astype(np.int64)
        to_bin, place, room = best_fit(used, capacity)
        ids, b = _bin_ids(round_no, len(room), 0), to_bin[item]
        out = [t[c].to_pylist() for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        yield from batches(schema, [*out, ids[b], t["offset"].to_numpy() + place[item], room[b]])

    return run


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0, slack: int = SLACK, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids followed by end_id; only one longer than the capacity is cut. Each task packs what it
    reads by best-fit decreasing. Bins with no more than `slack` room are done; the others are items of the next
    round, dealt out by a hash to ever fewer groups of about max_rows rows, until one group is left. If a round of
    several groups no longer lowers the number of bins by one in twenty, hardly any two of them fit together: those
    more than half full are done then. Any two of the rest do fit, so the rounds after that halve them down to one
    group, and nothing is ever left out.

    Null text is the empty document (one id). Null and repeated ids are packed like others, row by row. An empty
    table gives no rows. Other columns are not read.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "pack")
    path = tokenizer or default_tokenizer()
    current = scratch.write(ids_and_texts(df, id_col, text_col).mapInArrow(_packer(path, capacity, end_id, max_rows), SCHEMA), "round0")
    done = []
    for round_no in count(1):
        done.append(current.where(F.col("room") <= slack))
        current = current.where(F.col("room") > slack)
        n, bins = current.agg(F.count(F.lit(1)), F.count_distinct("sequence_id")).first()
        if not n:
            break
        groups = -(-n // max_rows)
        dealt = current.repartitionById(groups, F.pmod(F.xxhash64("sequence_id", F.lit(round_no)), F.lit(groups)).cast("int"))
        current = scratch.write(dealt.mapInArrow(_merger(round_no, capacity), SCHEMA), f"round{round_no}")
        if groups == 1:
            done.append(current)
            break
        after = current.agg(F.count_distinct("sequence_id")).first()[0]
        if after > STALLED * bins or round_no >= MOST_ROUNDS:
            done.append(current.where((F.col("room") > slack) & (F.col("room") * 2 < capacity)))
            current = current.where((F.col("room") <= slack) | (F.col("room") * 2 >= capacity))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("room")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
