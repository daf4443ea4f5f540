"""Live evidence: windowed observation summaries, repeat removal, per-key rings and queues with state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.redaction import SECRET_PATTERNS
from ..functions.values import is_finite


def windowed_summary(events: DataFrame, time: str, window: str, by: list[str], value: str, delay: str = "10 minutes") -> DataFrame:
    """window_start, by..., n, mean, nonfinite per event-time window; late rows beyond the delay are dropped."""
    ok = is_finite(F.col(value))
    marked = events.withWatermark(time, delay)
    return marked.groupBy(F.window(time, window).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(ok, F.col(value))).alias("mean"), F.count_if(~ok).alias("nonfinite")).select(F.col("w.start").alias("window_start"), *by, "n", "mean", "nonfinite")


def without_repeats(events: DataFrame, time: str, key: list[str], delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def sessions(events: DataFrame, time: str, gap: str, by: list[str], delay: str = "10 minutes") -> DataFrame:
    grouped = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("s"), *by)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), *by, "n")


def findings(documents: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Counts of secrets in streamed texts, stateless."""
    return documents.select(*keep, *[F.regexp_count(F.col(text), F.lit(p)).alias(n.replace("-", "_")) for n, p, _ in SECRET_PATTERNS])


RING_OUT = "key long, seen long, dropped long, first_abnormal long, newest array<long>"
RING_STATE = "seen long, first_abnormal long, newest array<long>"


def ring(events: DataFrame, key: str, seq: str, abnormal: str, capacity: int = 2048) -> DataFrame:
    """Per key the newest `capacity` sequence numbers, how many were dropped, and the first abnormal one, which
    survives when the ring has let it go. State is bounded by the capacity."""

    def update(k: tuple, batches: Iterator[Any], state: Any) -> Iterator[Any]:
        import pandas as pd

        seen, first, newest = state.get if state.exists else (0, None, [])
        newest = list(newest)
        for pdf in batches:
            seen += len(pdf)
            bad = pdf.loc[pdf["abnormal"], "seq"]
            if len(bad):
                first = int(bad.min()) if first is None else min(first, int(bad.min()))
            newest = sorted([*newest, *map(int, pdf["seq"])])[-capacity:]
        state.update((seen, first, newest))
        yield pd.DataFrame([{"key": k[0], "seen": seen, "dropped": max(0, seen - capacity), "first_abnormal": first, "newest": newest}])

    rows = events.select(F.col(key).cast("long").alias("key"), F.col(seq).cast("long").alias("seq"), F.col(abnormal).alias("abnormal"))
    return rows.groupBy("key").applyInPandasWithState(update, RING_OUT, RING_STATE, "update", "NoTimeout")


QUEUE_OUT = "key long, seq long, state string"


def queue(ops: DataFrame, key: str, seq: str, fails: str) -> DataFrame:
    """Per key in order: applied until one fails, blocked from there on, over all batches."""

    def update(k: tuple, batches: Iterator[Any], state: Any) -> Iterator[Any]:
        import pandas as pd

        (blocked,) = state.get if state.exists else (False,)
        rows = []
        for s, f in sorted(pair for pdf in batches for pair in zip(pdf["seq"], pdf["fails"], strict=True)):
            rows.append({"key": k[0], "seq": int(s), "state": "blocked" if blocked else "failed" if f else "applied"})
            blocked = blocked or bool(f)
        state.update((blocked,))
        yield pd.DataFrame(rows)

    rows = ops.select(F.col(key).cast("long").alias("key"), F.col(seq).cast("long").alias("seq"), F.col(fails).alias("fails"))
    return rows.groupBy("key").applyInPandasWithState(update, QUEUE_OUT, "blocked boolean", "append", "NoTimeout")
