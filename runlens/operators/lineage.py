"""Lineage from text: SQL, OpenLineage events, diffs. Nothing that is read is ever executed.

Parsers that need a scanner run as Arrow-batched Python over documents; the rest is column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import spread

SQL_EDGES = "id string, name string, relation string, dynamic boolean"
#: Table functions that read a file.
SCAN_FUNCTIONS = ("read_parquet", "parquet_scan", "read_csv", "read_csv_auto", "read_json", "read_json_auto")

_TOKEN = re.compile(r"""--[^\n]*|\#[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|[A-Za-z_$][\w$]*|[{}(),;.*<>]|\d+|\S""", re.S)
_STOP = {"where", "group", "order", "having", "limit", "union", "except", "intersect", "on", "using", "set", "values", "select", "window", "qualify", "when", "then", "returning"}


def sql_tokens(text: str) -> list[str]:
    """Tokens without comments; quoted text stays one token."""
    return [t for t in _TOKEN.findall(text) if not t.startswith(("--", "#", "/*"))]


def sql_lineage(text: str) -> list[tuple[str, str, bool]]:
    """(name, reads or writes, dynamic) of the tables and files of SQL statements.

    All tables of a FROM list count, targets of INSERT, CREATE, UPDATE, DELETE and MERGE are writes only, and common
    table expressions (recursive and with column lists too) are left out. A name with a placeholder is dynamic.
    """
    found: dict[tuple[str, str], bool] = {}
    tokens = sql_tokens(text)
    low = [t.lower() for t in tokens]
    ctes = {low[i - 1] for i in range(1, len(low) - 1) if low[i] == "as" and low[i + 1] == "(" and low[i - 1] != ")"}
    for i in range(len(low) - 2):  # name ( columns ) as (
        if low[i] == ")" and low[i + 1] == "as" and low[i + 2] == "(":
            depth, j = 0, i
            while j >= 0:
                depth += (low[j] == ")") - (low[j] == "(")
                if not depth:
                    break
                j -= 1
            if j > 0 and (j < 2 or low[j - 2] in ("with", ",", "recursive")):
                ctes.add(low[j - 1])

    def name_at(i: int) -> tuple[str | None, int]:
        """A dotted or quoted name, or the file that a scan function reads."""
        parts: list[str] = []
        while i < len(tokens):
            t = tokens[i]
            if re.fullmatch(r"[A-Za-z_$][\w$]*", t) or t[0] in "\"`":
                parts.append(t.strip("\"`"))
            elif t[0] == "'":
                return t.strip("'"), i + 1
            elif t in "{<":
                end = next((j for j in range(i, len(tokens)) if tokens[j] in "}>"), i)
                parts.append("".join(tokens[i : end + 1]))
                i = end
            else:
                break
            if i + 1 < len(tokens) and tokens[i + 1] == ".":
                i += 2
                continue
            i += 1
            break
        if not parts:
            return None, i
        if parts[-1].lower() in SCAN_FUNCTIONS and tokens[i : i + 1] == ["("]:
            inner = next((t.strip("'") for t in tokens[i:] if t[0] == "'"), None)
            return inner, i
        return ".".join(parts), i

    def add(i: int, relation: str) -> int:
        name, after = name_at(i)
        if name and name.lower() not in ctes and name.lower() not in _STOP:
            found[(name, relation)] = bool(re.search(r"[${}<>*]", name))
        return after

    i = 0
    while i < len(low):
        t, before = low[i], low[i - 1] if i else ""
        if t == "from" and before == "delete":
            add(i + 1, "writes")
        elif t == "from" and before not in ("distinct",):
            at, depth = add(i + 1, "reads"), 0
            while at < len(low):  # the rest of a comma list
                if low[at] in _STOP | {"join", "left", "right", "inner", "full", "cross", "natural", ";"} and not depth or depth < 0:
                    break
                depth += (low[at] == "(") - (low[at] == ")")
                if low[at] == "," and not depth:
                    at = add(at + 1, "reads")
                    continue
                at += 1
        elif t == "join" or (t == "using" and "merge" in low[:i]):
            if low[i + 1 : i + 2] != ["("]:
                add(i + 1, "reads")
        elif t == "into" or (t == "update" and before not in ("for", "do", "then")):
            add(i + 1, "writes")
        elif t in ("table", "view") and "create" in low[max(0, i - 4) : i]:
            add(i + 4 if low[i + 1 : i + 4] == ["if", "not", "exists"] else i + 1, "writes")
        elif t == "to" and "copy" in low[max(0, i - 40) : i]:
            add(i + 1, "writes")
        i += 1
    return sorted((n, r, d) for (n, r), d in found.items())


def read_sql(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, name, relation, dynamic for every SQL text; a text that can't be read gives no rows."""

    def run(source: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        schema = pa.schema([("id", pa.string()), ("name", pa.string()), ("relation", pa.string()), ("dynamic", pa.bool_())])
        for batch in source:
            rows = [(i, *edge) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for edge in sql_lineage(text or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(schema)], schema=schema)

    return spread(df.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))).mapInArrow(run, SQL_EDGES)


OPENLINEAGE = "struct<eventType:string,job:struct<namespace:string,name:string>,inputs:array<struct<namespace:string,name:string>>,outputs:array<struct<namespace:string,name:string>>>"


def read_openlineage(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """source, target, kind of OpenLineage events in JSON lines; malformed lines are dropped, repeats count once."""
    name = lambda s: F.concat_ws("/", F.coalesce(s["namespace"], F.lit("default")), s["name"])
    event = lines.select(F.from_json(text_col, OPENLINEAGE).alias("e")).where("e.job.name IS NOT NULL").select(name(F.col("e.job")).alias("job"), "e.inputs", "e.outputs")
    reads = event.select("job", F.explode("inputs").alias("d")).where("d.name IS NOT NULL").select(F.col("job").alias("source"), name(F.col("d")).alias("target"), F.lit("reads").alias("kind"))
    writes = event.select("job", F.explode("outputs").alias("d")).where("d.name IS NOT NULL").select(name(F.col("d")).alias("source"), F.col("job").alias("target"), F.lit("produced_by").alias("kind"))
    return reads.unionByName(writes).distinct()


def openlineage_event(job: Column, inputs: Column, outputs: Column, namespace: str = "runlens", event_type: str = "COMPLETE") -> Column:
    """One event as JSON, with a run id that is a function of its content."""
    dataset = lambda n: F.struct(n.alias("name"), F.lit(namespace).alias("namespace"))
    h = F.md5(F.concat_ws("\x1f", F.lit(namespace), job, F.array_join(inputs, ","), F.array_join(outputs, ",")))
    run = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.to_json(F.struct(F.lit(event_type).alias("eventType"), F.transform(inputs, dataset).alias("inputs"), F.struct(job.alias("name"), F.lit(namespace).alias("namespace")).alias("job"), F.transform(outputs, dataset).alias("outputs"), F.struct(run.alias("runId")).alias("run")))


def parse_diff(lines: DataFrame, by: list[str], place: str = "place", text: str = "line") -> DataFrame:
    """by..., path, side (added or removed), line of unified diffs given line by line; running sums over hunks."""
    w = Window.partitionBy(*by).orderBy(place)
    path = F.nullif(F.regexp_extract(text, r"^\+\+\+ (?:b/)?(\S+)", 1), F.lit(""))
    old = F.nullif(F.regexp_extract(text, r"^--- (?:a/)?(\S+)", 1), F.lit(""))
    hunk = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
    start = F.col(text).rlike(hunk)
    head = F.col(text).rlike(r"^(\+\+\+ |--- |diff --git |index )")
    rows = lines.withColumns({"start_": start, "head_": head, "path_": F.when(path != "/dev/null", path), "old_": old})
    rows = rows.withColumns({"hunk_": F.sum(F.col("start_").cast("int")).over(w), "file_": F.sum(F.col("old_").isNotNull().cast("int")).over(w)})
    whole = Window.partitionBy(*by, "file_")
    rows = rows.withColumns({"path": F.max("path_").over(whole), "oldpath_": F.max("old_").over(whole)})
    inside = rows.where("hunk_ > 0 AND NOT head_")
    h = Window.partitionBy(*by, "hunk_").orderBy(place)
    first = lambda g: F.first(F.when(F.col("start_"), F.regexp_extract(text, hunk, g).cast("long")), True).over(h)
    mark = F.substring(text, 1, 1)
    plus, minus, context = mark == "+", mark == "-", ~F.col("start_") & ~mark.isin("+", "-", "\\")
    counted = inside.withColumns({"new_": first(2) + F.sum((plus | context).cast("long")).over(h) - 1, "gone_": first(1) + F.sum((minus | context).cast("long")).over(h) - 1})
    side = F.when(plus, "added").when(minus, "removed")
    return counted.where(plus | minus).select(*by, F.coalesce("path", "oldpath_").alias("path"), side.alias("side"), F.when(plus, F.col("new_")).otherwise(F.col("gone_")).alias("line"))


def reader_of(path: Column) -> Column:
    """The format that a path's name suggests."""
    p = F.lower(path)
    return (
        F.when(p.endswith(".sql"), "sql").when(p.endswith(".ipynb"), "notebook").when(F.regexp_like(p, F.lit(r"\.(sh|bash|zsh)$")), "shell").when(F.regexp_like(p, F.lit(r"(^|/)dvc\.ya?ml$")), "dvc").when(F.regexp_like(p, F.lit(r"\.ya?ml$")), "pipeline").when(p.endswith(".py"), "python").when(F.regexp_like(p, F.lit(r"\.jsonl?$")), "openlineage").otherwise("unknown")
    )


def looks_dynamic(name: Column) -> Column:
    return F.regexp_like(name, F.lit(r"[${}<>*]"))


def module_name(path: Column) -> Column:
    """a/b/__init__.py and a/b.py to a.b."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^\./", ""), r"(/__init__)?\.py$", "")
    return F.replace(bare, F.lit("/"), F.lit("."))
