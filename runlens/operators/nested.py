"""Open nested values as leaf tables: paths, sizes, shapes, secrets, digests; and models compared case by case."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.redaction import REDACTED, SECRET_PATTERNS, names_secret
from .tables import output_parity, parity_cases

RAN = "case_id string, expected string, expected_error string, actual string, actual_error string"
LEAVES = "case_id string, path string, num double, str string, leaf_type string"


def walk(value: Any, path: str = "$") -> Iterator[tuple[str, Any]]:
    """(path, leaf) in order: $['key'] and $[index]; empty containers are leaves."""
    if isinstance(value, dict) and value:
        for key in value:
            yield from walk(value[key], f"{path}['{key}']")
    elif isinstance(value, list) and value:
        for i, item in enumerate(value):
            yield from walk(item, f"{path}[{i}]")
    else:
        yield path, value


def _kind(leaf: Any) -> str:
    return "null" if leaf is None else "boolean" if isinstance(leaf, bool) else "number" if isinstance(leaf, int | float) else "string" if isinstance(leaf, str) else "empty"


def shape(value: Any) -> list[int] | None:
    """The shape of nested lists; None if they are ragged."""
    if not isinstance(value, list):
        return []
    inner = [shape(v) for v in value]
    if any(s is None or s != inner[0] for s in inner):
        return None
    return [len(value), *(inner[0] if inner else [])]


def size(value: Any) -> int:
    return sum(map(size, value.values() if isinstance(value, dict) else value)) if isinstance(value, dict | list) else 1


def _over(df: DataFrame, id_col: str, json_col: str, schema: str, rows: Callable[[str, Any], list[tuple]]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(source: Iterator[Any]) -> Iterator[Any]:
        import pandas as pd

        for pdf in source:
            out: list[tuple] = []
            for case, text in zip(pdf["case_id"], pdf["text"], strict=True):
                try:
                    value = json.loads(text)
                except (TypeError, ValueError):
                    continue
                out += rows(case, value)
            yield pd.DataFrame(out, columns=names)

    return df.select(F.col(id_col).cast("string").alias("case_id"), F.col(json_col).cast("string").alias("text")).mapInPandas(run, schema)


def leaves(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """case_id, path, num, str, leaf_type of JSON values; what is not JSON gives no rows."""

    def rows(case: str, value: Any) -> list[tuple]:
        return [(case, p, float(v) if _kind(v) == "number" else None, v if isinstance(v, str) else None if _kind(v) == "number" else json.dumps(v), _kind(v)) for p, v in walk(value)]

    return _over(df, id_col, json_col, LEAVES, rows)


def profile(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """case_id, elements, shape (comma-separated; null if ragged or not lists)."""

    def rows(case: str, value: Any) -> list[tuple]:
        s = shape(value)
        return [(case, size(value), ",".join(map(str, s)) if s else None)]

    return _over(df, id_col, json_col, "case_id string, elements long, shape string", rows)


def scan_json(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """case_id, path, kind of secrets in nested values: by the key over a leaf or by its text, never the value."""
    patterns = [(name, p) for name, p, _ in SECRET_PATTERNS]

    def rows(case: str, value: Any) -> list[tuple]:
        found = []
        for path, leaf in walk(value):
            last = re.findall(r"\['([^']*)'\]", path)
            if last and names_secret(last[-1]) and leaf is not None:
                found.append((case, path, "secret-key"))
            if isinstance(leaf, str):
                found += [(case, path, name) for name, p in patterns if re.search(p, leaf)]
        return found

    return _over(df, id_col, json_col, "case_id string, path string, kind string", rows).distinct()


def redact_tree(value: Any) -> Any:
    """A nested value without secrets: members named like one are hidden whole, texts by the patterns."""
    if isinstance(value, dict):
        return {k: REDACTED if names_secret(str(k)) and v is not None else redact_tree(v) for k, v in value.items()}
    if isinstance(value, list):
        return [redact_tree(v) for v in value]
    if isinstance(value, str):
        for _, pattern, kept in SECRET_PATTERNS:
            value = re.sub(pattern, kept.replace("$", "\\"), value)
    return value


def redact_json(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """case_id, json: nested values without secrets, as canonical JSON; what is not JSON gives no row."""
    return _over(df, id_col, json_col, "case_id string, json string", lambda case, value: [(case, json.dumps(redact_tree(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))])


def snapshot(value: Any, max_elements: int = 4096, max_depth: int = 8) -> tuple[Any, bool]:
    """(a copy with at most max_elements leaves and max_depth levels, whether something was left out), in order."""
    left, cut = max_elements, False

    def copy(now: Any, depth: int) -> Any:
        nonlocal left, cut
        if isinstance(now, dict | list):
            if depth >= max_depth:
                cut = cut or bool(now)
                return None
            out: list[tuple[Any, Any]] = []
            for k, v in now.items() if isinstance(now, dict) else enumerate(now):
                if left <= 0:
                    cut = True
                    break
                out.append((k, copy(v, depth + 1)))
            return dict(out) if isinstance(now, dict) else [v for _, v in out]
        left -= 1
        return now

    return copy(value, 0), cut


def snapshots(df: DataFrame, id_col: str, json_col: str, max_elements: int = 4096, max_depth: int = 8) -> DataFrame:
    """case_id, json, truncated: bounded copies of nested values."""

    def rows(case: str, value: Any) -> list[tuple]:
        kept, cut = snapshot(value, max_elements, max_depth)
        return [(case, json.dumps(kept, sort_keys=True, separators=(",", ":")), cut)]

    return _over(df, id_col, json_col, "case_id string, json string, truncated boolean", rows)


def compare_batches(reference: Callable[[list[Any]], list[Any]], candidate: Callable[[list[Any]], list[Any]], cases: DataFrame, id_col: str = "case_id", input_col: str = "input", **policy: Any) -> tuple[DataFrame, DataFrame]:
    """compare_models for models that take a list of inputs and give as many outputs; another number is an error of all
    the cases in that call."""

    def each(model: Callable[[list[Any]], list[Any]]) -> Callable[[list[Any]], list[tuple[str | None, str | None]]]:
        def run(values: list[Any]) -> list[tuple[str | None, str | None]]:
            try:
                got = list(model(values))
                if len(got) != len(values):
                    raise ValueError(f"{len(got)} outputs of {len(values)} inputs")
                return [(json.dumps(g), None) for g in got]
            except Exception as e:  # a model may fail in any way; the failure is the result
                return [(None, f"{type(e).__name__}: {e}")] * len(values)

        return run

    def run(source: Iterator[Any]) -> Iterator[Any]:
        import pandas as pd

        for pdf in source:
            values = [json.loads(t) for t in pdf["text"]]
            expected, actual = each(reference)(values), each(candidate)(values)
            yield pd.DataFrame([(c, *e, *a) for c, e, a in zip(pdf["case_id"], expected, actual, strict=True)], columns=["case_id", "expected", "expected_error", "actual", "actual_error"])

    return _judged(cases.select(F.col(id_col).cast("string").alias("case_id"), F.col(input_col).cast("string").alias("text")).mapInPandas(run, RAN), policy)


def capsule_digest(members: DataFrame) -> DataFrame:
    """capsule, sha256 over the sorted (member, digest) records."""
    record = F.struct("member", "sha256")
    return members.where("sha256 IS NOT NULL").groupBy("capsule").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(record))), 256).alias("sha256"))


def compare_models(cases: DataFrame, reference: Callable[[Any], Any], candidate: Callable[[Any], Any], id_col: str = "case_id", input_col: str = "input", **policy: Any) -> tuple[DataFrame, DataFrame]:
    """(cases, leaves): both models run over JSON inputs in batches, and their outputs compared leaf by leaf.

    A case on which the reference fails is inconclusive, one on which only the candidate fails is an error.
    """

    def run(source: Iterator[Any]) -> Iterator[Any]:
        import pandas as pd

        for pdf in source:
            rows = []
            for case, text in zip(pdf["case_id"], pdf["text"], strict=True):
                got = []
                for model in (reference, candidate):
                    try:
                        got += [json.dumps(model(json.loads(text))), None]
                    except Exception as e:  # a model may fail in any way; the failure is the result
                        got += [None, f"{type(e).__name__}: {e}"]
                rows.append((case, *got))
            yield pd.DataFrame(rows, columns=["case_id", "expected", "expected_error", "actual", "actual_error"])

    inputs = cases.select(F.col(id_col).cast("string").alias("case_id"), F.col(input_col).cast("string").alias("text"))
    return _judged(inputs.mapInPandas(run, RAN), policy)


def _judged(ran: DataFrame, policy: dict[str, Any]) -> tuple[DataFrame, DataFrame]:
    """(cases with their status, leaves) of what two models gave."""
    compared = output_parity(leaves(ran, "case_id", "expected"), leaves(ran, "case_id", "actual"), ["case_id"], **policy)
    status = F.when(F.col("expected_error").isNotNull(), "inconclusive").when(F.col("actual_error").isNotNull(), "error").when(F.coalesce("passed", F.lit(True)), "pass").otherwise("fail")
    return ran.select("case_id", "expected_error", "actual_error").join(parity_cases(compared, ["case_id"]), "case_id", "left").withColumn("status", status), compared
