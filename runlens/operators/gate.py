"""The policy gate: evidence to named checks and one exit code; missing evidence is never a pass."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions.decisions import severity


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_")


def _check(name: str, status: Column, details: Column) -> list[Column]:
    return [F.lit(name).alias("name"), slug(F.lit(name)).alias("check_id"), status.alias("status"), details.cast("string").alias("details")]


def checks(comparison: DataFrame, health: DataFrame | None = None, parity: DataFrame | None = None, required: list[str] | None = None, fail_on_failed_run: bool = True, fail_on_nonfinite: bool = True, fail_on_missing_evidence: bool = True, fail_on_parity_failure: bool = True) -> DataFrame:
    """name, check_id, status (pass, warn, fail), details: one row per rule, from aggregations of the evidence."""
    n = F.count_if
    facts = comparison.agg(
        F.count(F.lit(1)).alias("metrics"),
        n(F.col("candidate_nonfinite") > 0).alias("cand"),
        n(F.col("baseline_nonfinite") > 0).alias("base"),
        n(F.col("candidate_missing") | F.col("baseline_missing")).alias("missing"),
        n((F.col("paired_finite_observations") == 0) | (F.col("status") == "inconclusive")).alias("thin"),
        n("regression").alias("regressed"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("regression"), F.col("name")))), ",").alias("names"),
    )

    def grade(bad: Column, strict: bool) -> Column:
        return F.when(bad, "fail" if strict else "warn").otherwise("pass")

    rules = [
        ("no metric regression", grade(F.col("regressed") > 0, True), F.col("names")),
        ("no non-finite candidate observations", grade(F.col("cand") > 0, fail_on_nonfinite), F.col("cand")),
        ("no non-finite baseline observations", grade(F.col("base") > 0, fail_on_nonfinite), F.col("base")),
        ("evidence present", grade((F.col("missing") > 0) | (F.col("metrics") == 0), fail_on_missing_evidence), F.col("missing")),
        ("sufficient evidence", grade((F.col("thin") > 0) | (F.col("metrics") == 0), fail_on_missing_evidence), F.col("thin")),
    ]
    stacked = F.explode(F.array(*[F.struct(*_check(name, status, details)) for name, status, details in rules]))
    out = facts.select(stacked.alias("c")).select("c.*")
    if health is not None:
        sick = health.agg(F.coalesce(F.bool_or(F.col("any_failed") | F.col("any_incomplete")), F.lit(True)).alias("sick"), F.array_join(F.array_sort(F.flatten(F.collect_list("failed_runs"))), ",").alias("runs"))
        out = out.unionByName(sick.select(*_check("run completed successfully", grade(F.col("sick"), fail_on_failed_run), F.col("runs"))))
    if parity is not None:
        result = parity.agg(F.count_if(~F.col("parity")).alias("bad"), F.count_if(F.col("parity").isNull()).alias("open"), F.count(F.lit(1)).alias("n"))
        failed = (F.col("bad") > 0) | (F.col("open") > 0) | (F.col("n") == 0)
        out = out.unionByName(result.select(*_check("parity", grade(failed, fail_on_parity_failure), F.col("bad"))))
    if required:
        wanted = comparison.sparkSession.createDataFrame([(r,) for r in required], "name string")
        there = comparison.where("candidate_observations > 0").select("name")
        absent = wanted.join(there, "name", "left_anti").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
        out = out.unionByName(absent.select(*_check("required evidence", grade(F.col("n") > 0, True), F.col("names"))))
    return out


def result(rows: DataFrame) -> DataFrame:
    """passed, exit_code, failed, warnings; no checks at all is a failure."""
    failed = F.count_if(F.col("status") == "fail")
    bad = (failed > 0) | (F.count(F.lit(1)) == 0)
    return rows.agg((~bad).alias("passed"), F.when(bad, 1).otherwise(0).alias("exit_code"), F.array_sort(F.collect_list(F.when(F.col("status") == "fail", F.col("check_id")))).alias("failed"), F.array_sort(F.collect_list(F.when(F.col("status") == "warn", F.col("check_id")))).alias("warnings"))


def report(rows: DataFrame, kind: str = "text") -> str:
    """The checks (a handful of rows) as text, json, junit, sarif or github annotations."""
    import json
    from xml.sax.saxutils import quoteattr

    found: list[dict[str, Any]] = [r.asDict() for r in rows.orderBy("check_id").collect()]
    bad = [c for c in found if c["status"] == "fail"]
    if kind == "json":
        return json.dumps({"passed": bool(found) and not bad, "checks": found}, sort_keys=True)
    if kind == "junit":
        cases = "".join(f"<testcase name={quoteattr(c['name'])}>" + (f"<failure message={quoteattr(c['details'] or '')}/>" if c["status"] == "fail" else "") + "</testcase>" for c in found)
        return f'<testsuite name="gate" tests="{len(found)}" failures="{len(bad)}">{cases}</testsuite>'
    if kind == "sarif":
        results = [{"ruleId": c["check_id"], "level": "error" if c["status"] == "fail" else "warning", "message": {"text": f"{c['name']}: {c['details']}"}} for c in found if c["status"] != "pass"]
        return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "runlens", "rules": [{"id": c["check_id"]} for c in found]}}, "results": results}]}, sort_keys=True)
    if kind == "github":
        return "\n".join(f"::{'error' if c['status'] == 'fail' else 'warning'} title={c['name']}::{c['details']}" for c in found if c["status"] != "pass")
    return "\n".join([f"{c['status'].upper():5} {c['name']}" + (f" ({c['details']})" if c["details"] else "") for c in found] + ["FAIL" if bad or not found else "PASS"])


def ci_gate(baseline: DataFrame, candidate: DataFrame, runs: DataFrame | None = None, parity: DataFrame | None = None, required: list[str] | None = None, extra: DataFrame | None = None, policy: Mapping[str, bool] | None = None, **options: Any) -> tuple[int, DataFrame]:
    """(exit code, checks) of two sides' observations: compared, judged by the policy, with the caller's own checks.

    baseline and candidate are name, token, value; runs is side, status, run_id; extra has the columns of checks.
    """
    from .comparison import compare, run_health

    rows = checks(compare(baseline, candidate, **options), None if runs is None else run_health(runs), parity, required, **(policy or {}))
    if extra is not None:
        rows = rows.unionByName(extra.select("name", "check_id", "status", "details"))
    rows = checkpointed(rows)
    return result(rows).first().exit_code, rows


def render_comparison(comparison: DataFrame, top: int = 100) -> str:
    """The comparison as text: a line per metric, the gravest first, of at most `top` metrics and the number of others."""
    rank = severity(F.col("status"))
    rows = comparison.orderBy(F.desc(rank), "name").limit(top).collect()
    number = lambda x: "-" if x is None else f"{x:.6g}"
    lines = [f"{r.status.upper():12} {r.name}: {number(r.estimate)} [{number(r.lower)}, {number(r.upper)}], {r.shared_observations} pairs" for r in rows]
    rest = comparison.count() - len(rows)
    return "\n".join(lines + ([f"and {rest} more"] if rest else []) or ["no metrics: inconclusive"])
