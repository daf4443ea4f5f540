"""Retention plans and per-key ordered queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def retention_plan(items: DataFrame, by: list[str], now: float, max_age: float | None, budget: float | None, keep_recent: int = 0, path: str = "path", size: str = "size", mtime: str = "mtime", protected: str | None = None) -> DataFrame:
    """by..., path, reason (age or budget) of items to collect.

    Per group the keep_recent newest, and protected ones, never go. Others go if older than max_age. If what is left
    exceeds the budget, the oldest eligible ones go until it doesn't: an item goes if the total, less the eligible
    ones strictly before it, is over the budget.
    """
    w = Window.partitionBy(*by)
    recent = F.row_number().over(w.orderBy(F.desc(mtime), F.desc(path))) <= keep_recent
    safe = recent | F.coalesce(F.col(protected), F.lit(False)) if protected else recent
    old = ~F.col("safe_") & (F.lit(now) - F.col(mtime) > max_age) if max_age is not None else F.lit(False)
    rows = items.withColumn("safe_", safe).withColumn("old_", old)
    left = F.when(~F.col("old_"), F.col(size)).otherwise(0.0)
    eligible = F.when(~F.col("old_") & ~F.col("safe_"), F.col(size)).otherwise(0.0)
    before = F.coalesce(F.sum(eligible).over(w.orderBy(F.asc(mtime), F.asc(path)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    over = ~F.col("old_") & ~F.col("safe_") & (F.sum(left).over(w) - before > budget) if budget is not None else F.lit(False)
    reason = F.when(F.col("old_"), "age").when(over, "budget")
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select(*by, path, "reason")


def flush_queue(ops: DataFrame, key: str, order: list[str], fails: str) -> DataFrame:
    """Adds state: applied, failed, or blocked behind an earlier failure of the same key."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    blocked = F.coalesce(F.max(F.col(fails).cast("int")).over(before), F.lit(0)) == 1
    return ops.withColumn("state", F.when(blocked, "blocked").when(F.col(fails), "failed").otherwise("applied"))


def audit_events(actions: DataFrame, redact: list[str]) -> DataFrame:
    """Actions as JSON lines with redacted text columns, for an append-only sink."""
    from ..functions.redaction import redact_text

    safe = actions.withColumns({c: redact_text(F.col(c)) for c in redact})
    return safe.select(F.to_json(F.struct(*sorted(safe.columns))).alias("value"))
