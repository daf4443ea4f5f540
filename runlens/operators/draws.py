"""Bootstrap draws of large groups in workers: what moves is the groups' values, packed, and not a row for each draw."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import spread, tasks
from ..functions import words

#: Values of one packed block, and shares of the resamples that get a copy of a group's values each.
BLOCK, SHARES = 8192, 24
#: Rows times resamples of a group up to which one share makes all its resamples.
ONE_SHARE = 100_000


def _codes(columns: Sequence[Any], n: int) -> tuple[Any, Any]:
    """(each row's group from 0, each group's first row) of Arrow columns."""
    import numpy as np

    code = np.zeros(n, np.int64)
    for column in columns:
        part = column.dictionary_encode(null_encoding="encode")
        code = np.unique(code * len(part.dictionary) + part.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


def _statistic(kind: str, values: Any, valid: Any, n: int, drawn: Iterator[Any]) -> float | None:
    """A statistic of the values at the drawn places; nulls don't count, and NaN is the largest number, as in Spark."""
    import numpy as np

    if kind in ("mean", "sum"):
        total, count = 0.0, 0
        for places in drawn:
            total += float(values[places].sum())
            count += len(places) if valid is None else int(valid[places].sum())
        return None if not count else total / count if kind == "mean" else total
    got, at = np.empty(n), 0
    for places in drawn:
        kept = values[places] if valid is None else values[places[valid[places]]]
        got[at : at + len(kept)] = kept
        at += len(kept)
    got = got[:at]
    if not at:
        return None
    if kind == "p95":
        place = max(math.ceil(0.95 * at), 1) - 1
        got.partition(place)
        return float(got[place])
    low, high = (at - 1) // 2, at // 2  # the median
    got.partition([low, high])
    return float(got[low] + got[high]) / 2 if low != high else float(got[low])


KINDS = ("mean", "sum", "median", "p95")


def drawn_statistics(df: DataFrame, by: list[str], order: Sequence[str | Column], value: str, resamples: int, seed: int, kind: str) -> DataFrame:
    """by..., r, s: one of KINDS over each resample's hashed draws, those of statistics.resampled.

    Values are sorted by range partitions and packed into blocks; each share of the resamples gets its copy of a group's
    blocks, and a task holds one group's values at a time. A small group whose neighbours on both sides are in its batch is
    known to be whole there, and one share draws it.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    n_by, shares = len(by), min(SHARES, resamples)
    rows = df.select(*by, *[c.alias(f"order_{i}") for i, c in enumerate(order)], F.col(value).cast("double").alias("value_"))
    keys = [*by, *[f"order_{i}" for i in range(len(order))]]
    apart = not any(re.search("float|double|collate", f.dataType.simpleString()) for f in df.select(*by).schema)  # equal keys are equal bytes
    ranged = rows.repartitionByRange(tasks(df), *keys).sortWithinPartitions(*keys).select(*by, F.spark_partition_id().alias("part_"), "value_")

    def pack(source: Iterator[Any]) -> Iterator[Any]:
        import numpy as np
        import pyarrow as pa

        block = 0
        for batch in source:
            n = batch.num_rows
            if not n:
                continue
            code, _ = _codes(batch.columns[:n_by], n)
            edges = np.unique([0, *(np.flatnonzero(np.diff(code)) + 1), *range(0, n, BLOCK), n])
            value = batch.column(n_by + 1)
            there = value.is_valid().to_numpy(zero_copy_only=False)
            numbers = np.where(there, value.fill_null(0.0).to_numpy(zero_copy_only=False), 0.0)
            out = [(numbers[a:b].tobytes(), b"" if there[a:b].all() else there[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            starts = pa.array(edges[:-1])
            columns = [c.take(starts) for c in batch.columns[: n_by + 1]]
            columns += [pa.array(range(block, block + len(out)), pa.int64()), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())]
            whole = apart & (code != code[0]) & (code != code[-1]) & (np.bincount(code)[code] * resamples <= ONE_SHARE)
            columns.append(pa.array(np.where(whole[edges[:-1]], 1, shares).astype(np.int32)))
            block += len(out)
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[: n_by + 1], "block_", "values_", "there_", "shares_"])

    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema]
    packed = ranged.mapInArrow(pack, ", ".join([*own, "part_ int", "block_ long", "values_ binary", "there_ binary", "shares_ int"]))
    copies = packed.withColumn("share_", F.explode(F.sequence(F.lit(0), F.col("shares_") - 1)))
    dealt = copies.repartition(tasks(df), *by, "share_").sortWithinPartitions(*by, "share_", "part_", "block_")

    def draw(source: Iterator[Any]) -> Iterator[Any]:
        import numpy as np
        import pyarrow as pa

        heads: dict[int, Any] = {}

        def hashed(r: int, start: int, stop: int) -> Iterator[Any]:
            for tails in words.digits(start, stop):
                yield from words.first_words([f"{seed}:{r}:".encode()], tails)

        def drawn(r: int, n: int) -> Iterator[Any]:
            if r not in heads:  # small groups share the first draws
                heads[r] = np.concatenate(list(hashed(r, 0, 4096)))
            yield (heads[r][:n] % n).astype(np.int64)
            for word in hashed(r, 4096, n):
                yield (word % np.uint32(n)).astype(np.int64)

        def finish(key: list[Any], share: int, of: int, held: list[tuple[bytes, bytes]]) -> Any:
            values = np.frombuffer(b"".join([x for x, _ in held]))
            valid = None
            if any(x for _, x in held):
                valid = np.frombuffer(b"".join([x or b"\1" * (len(v) // 8) for v, x in held]), bool)
            own = range(share, resamples, of)
            got = [_statistic(kind, values, valid, len(values), drawn(r, len(values))) for r in own]
            columns = [pa.concat_arrays([k] * len(own)) for k in key]
            return pa.RecordBatch.from_arrays([*columns, pa.array(own, pa.int32()), pa.array(got, pa.float64())], names=[*by, "r", "s"])

        key, now, of, held = None, None, 0, []
        for batch in source:
            values, there, ofs, shares_ = (batch.column(n_by + i) for i in (2, 3, 4, 5))
            for i in range(batch.num_rows):
                own = [c.slice(i, 1) for c in batch.columns[:n_by]]
                mark = (*[c.to_pylist()[0] for c in own], shares_[i].as_py())
                if mark != now:
                    if held:
                        yield finish(key, now[-1], of, held)
                    key, now, of, held = own, mark, ofs[i].as_py(), []
                held.append((values[i].as_py(), there[i].as_py()))
        if held:
            yield finish(key, now[-1], of, held)

    return dealt.mapInArrow(draw, ", ".join([*own, "r int", "s double"]))


def poisson_sums(df: DataFrame, by: list[str], key: Sequence[str | Column], value: str, resamples: int, seed: int) -> DataFrame:
    """by..., r, s (sum of weighted values, null without any) and w (sum of weights): the weights of
    statistics.poisson_draw, added up in workers without a row for each weight."""
    n_by = len(by)
    keys = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key]
    tail = F.concat_ws("", *[F.concat(F.lit(":"), k) for k in keys])  # a null key adds nothing
    rows = spread(df.select(*by, tail.alias("tail_"), F.col(value).cast("double").alias("value_")))
    bounds = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(9)]
    limits = [math.ceil(b * 2**32) for b in bounds]  # u < b as whole numbers

    def run(source: Iterator[Any]) -> Iterator[Any]:
        import numpy as np
        import pyarrow as pa

        prefixes = [f"{seed}:{r}".encode() for r in range(resamples)]

        def summed(table: Any) -> Iterator[Any]:
            columns = [c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) for c in table.columns]
            code, first = _codes(columns[:n_by], table.num_rows)
            groups = len(first)
            there = columns[n_by + 1].is_valid().to_numpy(zero_copy_only=False)
            value = np.where(there, columns[n_by + 1].fill_null(0.0).to_numpy(zero_copy_only=False), 0.0)
            texts = columns[n_by].cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            lengths = np.diff(offsets)
            sums, counts = np.zeros((resamples, groups)), np.zeros((resamples, groups))
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                for at in range(0, len(own), words.CHUNK):
                    rows = own[at : at + words.CHUNK]
                    tails = data[offsets[rows][:, None] + np.arange(length)]
                    group, v = code[rows], value[rows]
                    for r, word in enumerate(words.first_words(prefixes, tails)):
                        w = np.zeros(len(rows), np.int8)
                        for limit in limits:
                            if limit < 2**32:
                                w += word >= np.uint32(limit)
                        sums[r] += np.bincount(group, v * w, groups)
                        counts[r] += np.bincount(group, w, groups)
            some = np.tile(np.bincount(code, there, groups) > 0, resamples)
            places = pa.array(np.tile(first, resamples))
            out = [c.take(places) for c in columns[:n_by]]
            out += [pa.array(np.repeat(np.arange(resamples, dtype=np.int32), groups)), pa.array(sums.ravel(), mask=~some), pa.array(counts.ravel())]
            yield pa.RecordBatch.from_arrays(out, names=[*by, "r", "s", "w"])

        held, n = [], 0
        for batch in source:
            held.append(batch)
            n += batch.num_rows
            if n >= 4 * words.CHUNK:
                yield from summed(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from summed(pa.Table.from_batches(held))

    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema]
    parts = rows.mapInArrow(run, ", ".join([*own, "r int", "s double", "w double"]))
    return parts.groupBy(*by, "r").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
