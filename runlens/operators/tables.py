"""Parity of two tables and of nested outputs."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window, types as T
from pyspark.sql import functions as F

from ..functions.values import PROFILES, is_null_like, output_root, type_family, within_expected, within_symmetric

CELLS = "row_idx long, column string, kind string, reference string, candidate string"


def table_parity(reference: DataFrame, candidate: DataFrame, row: str = "row_idx", atol: float = 0.0, rtol: float = 0.0, check_order: bool = True, check_nulls: bool = True, check_types: bool = True, check_precision: bool = True) -> DataFrame:
    """Mismatches: row_idx, column, kind (schema, shape, type, null, precision, value, order), reference, candidate.

    Ordered mode joins the rows by their index and compares cell by cell; unordered mode compares the multisets of
    rows: equal ones cancel, and with a tolerance the rest is matched one to one.
    With check_precision false numbers must be equal.
    """
    spark = reference.sparkSession
    left, right = ([c for c in df.columns if c != row] for df in (reference, candidate))
    both = [c for c in left if c in right]
    lt, rt = ({f.name: f.dataType for f in df.schema} for df in (reference, candidate))
    fixed: list[tuple] = []
    if left != right:
        fixed.append((None, None, "schema", ",".join(left), ",".join(right)))
    odd = [c for c in both if check_types and type_family(lt[c]) != type_family(rt[c])]
    fixed += [(None, c, "type", lt[c].simpleString(), rt[c].simpleString()) for c in odd]
    out = spark.createDataFrame(fixed, CELLS)
    sizes = reference.agg(F.count(F.lit(1)).alias("a")).join(F.broadcast(candidate.agg(F.count(F.lit(1)).alias("b"))), F.lit(True))
    out = out.unionByName(sizes.where("a <> b").select(F.lit(None).cast("long").alias("row_idx"), F.lit(None).cast("string").alias("column"), F.lit("shape").alias("kind"), F.col("a").cast("string").alias("reference"), F.col("b").cast("string").alias("candidate")))
    if not check_order:
        return out.unionByName(_unordered(reference, candidate, [c for c in both if c not in odd], atol, rtol))
    l = reference.select(F.col(row).alias("row_idx"), *[F.col(c).alias(f"l_{c}") for c in both])
    r = candidate.select(F.col(row).alias("row_idx"), *[F.col(c).alias(f"r_{c}") for c in both])
    cells = [F.struct(F.lit(c).alias("column"), _cell_kind(F.col(f"l_{c}"), F.col(f"r_{c}"), lt[c], rt[c], atol, rtol, check_nulls, check_precision).alias("kind"), F.col(f"l_{c}").cast("string").alias("reference"), F.col(f"r_{c}").cast("string").alias("candidate")) for c in both if c not in odd]
    if cells:
        found = l.join(r, "row_idx").select("row_idx", F.explode(F.filter(F.array(*cells), lambda x: x["kind"].isNotNull())).alias("x"))
        out = out.unionByName(found.select("row_idx", "x.column", "x.kind", "x.reference", "x.candidate"))
    return out.unionByName(_order(reference, candidate, both, row))


def _cell_kind(a: Column, b: Column, ta: T.DataType, tb: T.DataType, atol: float, rtol: float, check_nulls: bool, check_precision: bool) -> Column:
    na, nb = is_null_like(a, ta), is_null_like(b, tb)
    if type_family(ta) in ("integer", "number") and type_family(tb) in ("integer", "number"):
        x, y = a.cast("double"), b.cast("double")
        same, kind = (within_symmetric(x, y, atol, rtol) if check_precision else x == y), "precision"
    else:
        same, kind = a.cast("string") == b.cast("string"), "value"
    null = F.when(F.lit(check_nulls) & (na != nb), "null")
    return F.when(na | nb, null).when(~same, kind)


def canonical_row(df: DataFrame, columns: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def multiset_difference(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """row, surplus: how many more of a row the left side has (negative: the right); one aggregation, no gathering."""
    signed = left.select(canonical_row(left, columns).alias("row"), F.lit(1).alias("s")).unionByName(right.select(canonical_row(right, columns).alias("row"), F.lit(-1).alias("s")))
    return signed.groupBy("row").agg(F.sum("s").alias("surplus")).where("surplus <> 0")


def _order(reference: DataFrame, candidate: DataFrame, columns: list[str], row: str) -> DataFrame:
    """One row of kind order if the rows are the same multiset in another order."""
    l, r = (df.select(F.col(row).alias("i"), canonical_row(df, columns).alias(n)) for df, n in ((reference, "a"), (candidate, "b")))
    moved = l.join(r, "i", "full_outer").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("moved"))
    surplus = multiset_difference(reference, candidate, columns).agg(F.count(F.lit(1)).alias("odd"))
    none = F.lit(None).cast("string")
    return moved.join(F.broadcast(surplus), F.lit(True)).where("moved > 0 AND odd = 0").select(F.lit(None).cast("long").alias("row_idx"), none.alias("column"), F.lit("order").alias("kind"), none.alias("reference"), none.alias("candidate"))


def _unordered(reference: DataFrame, candidate: DataFrame, columns: list[str], atol: float, rtol: float, max_residual: int = 10_000) -> DataFrame:
    """Exact matches cancel; what is left is matched one to one within the tolerance.

    With one numeric column the rest is matched in order of its values, whatever its size (_matched_in_order). With
    several, up to max_residual rows are matched here one after another, and more are reported as inconclusive rather
    than guessed, as the best matching of several columns can't be had in pieces.
    """
    import json

    spark = reference.sparkSession
    rest = multiset_difference(reference, candidate, columns)
    if not atol and not rtol:
        return rest.select(F.lit(None).cast("long").alias("row_idx"), F.lit(None).cast("string").alias("column"), F.lit("value").alias("kind"), F.when(F.col("surplus") > 0, F.col("row")).alias("reference"), F.when(F.col("surplus") < 0, F.col("row")).alias("candidate"))
    numbers = {f.name for f in reference.schema if type_family(f.dataType) in ("integer", "number")} & set(columns)
    if len(numbers) == 1:
        return _matched_in_order(rest, numbers.pop(), atol, rtol)
    left = rest.limit(max_residual + 1).collect()
    if len(left) > max_residual:
        return spark.createDataFrame([(None, None, "inconclusive", None, None)], CELLS)
    sides = [[json.loads(r.row) for r in left if r.surplus * sign > 0 for _ in range(abs(r.surplus))] for sign in (1, -1)]

    def close(a: dict, b: dict) -> bool:
        for c in columns:
            x, y = a[c], b[c]
            if x is None or y is None or c not in numbers:
                if x != y:
                    return False
            elif abs(float(x) - float(y)) > atol + rtol * max(abs(float(x)), abs(float(y))):
                return False
        return True

    missing = []
    for a in sides[0]:
        match = next((i for i, b in enumerate(sides[1]) if close(a, b)), None)
        if match is None:
            missing.append((None, None, "value", json.dumps(a, sort_keys=True), None))
        else:
            sides[1].pop(match)
    return spark.createDataFrame(missing + [(None, None, "value", None, json.dumps(b, sort_keys=True)) for b in sides[1]], CELLS)


def _matched_in_order(rest: DataFrame, number: str, atol: float, rtol: float) -> DataFrame:
    """What stays unmatched of rows with one numeric column, matched one to one within the tolerance.

    Rows that agree in all other columns are streamed in order of the number. A row takes the smallest waiting row of
    the other side that is near enough; as what is near moves on with the number, no other matching of the rows that are
    left has more pairs.
    Waiting are only rows within the tolerance of the newest one.
    """
    members = F.from_json("row", "map<string,string>")
    rows = rest.select("row", "surplus", F.to_json(F.map_filter(members, lambda k, _: k != number)).alias("key"), members[number].cast("double").alias("x"))
    usable = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))
    alone = rows.where(~usable).select("row", "surplus")

    def run(source: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        schema = pa.schema([("row", pa.string()), ("surplus", pa.int64())])
        now, side, waiting, out = None, 0, deque(), []

        def near(a: float, b: float) -> bool:
            return abs(a - b) <= atol + rtol * max(abs(a), abs(b))

        for batch in source:
            for row, surplus, key, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    out += [(r, side * n) for _, r, n in waiting]
                    now, waiting = key, deque()
                sign, n = (1, surplus) if surplus > 0 else (-1, -surplus)
                while waiting and (not near(waiting[0][0], x) or (n and side != sign)):
                    y, r, m = waiting.popleft()
                    if not near(y, x):
                        out.append((r, side * m))
                        continue
                    pairs = min(m, n)
                    n -= pairs
                    if m > pairs:
                        waiting.appendleft((y, r, m - pairs))
                if n:
                    side = sign
                    waiting.append((x, row, n))
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_pylist([{"row": r, "surplus": s} for r, s in out], schema=schema)
                    out = []
        out += [(r, side * n) for _, r, n in waiting]
        if out:
            yield pa.RecordBatch.from_pylist([{"row": r, "surplus": s} for r, s in out], schema=schema)

    ordered = rows.where(usable).select("row", "surplus", "key", "x").repartition("key").sortWithinPartitions("key", "x", "row")
    unmatched = ordered.mapInArrow(run, "row string, surplus long").unionByName(alone)
    each = unmatched.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.abs("surplus"))))
    return each.select(F.lit(None).cast("long").alias("row_idx"), F.lit(None).cast("string").alias("column"), F.lit("value").alias("kind"), F.when(F.col("surplus") > 0, F.col("row")).alias("reference"), F.when(F.col("surplus") < 0, F.col("row")).alias("candidate"))


def tolerances(df: DataFrame, policies: Mapping[str, tuple[float, float]], default: tuple[float, float], path: str = "path") -> DataFrame:
    """Adds atol, rtol of the most specific policy: exact path, then the output's name, then $, then *."""
    atol, rtol = F.lit(default[0]), F.lit(default[1])
    for key in ("*", "$"):
        if key in policies:
            atol, rtol = F.lit(policies[key][0]), F.lit(policies[key][1])
    root = output_root(F.col(path))
    for test in (root, F.col(path)):
        for key, (a, r) in policies.items():
            if key not in ("*", "$"):
                atol, rtol = F.when(test == key, a).otherwise(atol), F.when(test == key, r).otherwise(rtol)
    return df.withColumns({"atol": atol, "rtol": rtol})


def output_parity(expected: DataFrame, actual: DataFrame, keys: list[str], policies: Mapping[str, tuple[float, float]] | None = None, default: tuple[float, float] | str = (1e-6, 1e-5), nan_equal: bool = False, inf_equal: bool = True) -> DataFrame:
    """Leaf by leaf: keys..., path, root, reason (null if equal), abs_error, rel_error.

    Both sides are leaf tables keys..., path, num, str. A number is held to |e - a| <= atol + rtol * |e|; the default
    (atol, rtol) may be named by its number format, as in values.PROFILES.
    """
    default = PROFILES[default] if isinstance(default, str) else default
    e = expected.select(*keys, "path", F.col("num").alias("e_num"), F.col("str").alias("e_str"), F.lit(True).alias("e_"))
    a = actual.select(*keys, "path", F.col("num").alias("a_num"), F.col("str").alias("a_str"), F.lit(True).alias("a_"))
    both = tolerances(e.join(a, [*keys, "path"], "full_outer"), policies or {}, default)
    en, an = F.col("e_num"), F.col("a_num")
    reason = (
        F.when(F.col("a_").isNull(), "missing")
        .when(F.col("e_").isNull(), "unexpected")
        .when(en.isNotNull() & an.isNotNull(), F.when(~within_expected(en, an, F.col("atol"), F.col("rtol"), nan_equal, inf_equal), "value"))
        .when(en.isNull() != an.isNull(), "type")
        .when(~F.col("e_str").eqNullSafe(F.col("a_str")), "value")
    )
    error = F.when(en.isNotNull() & an.isNotNull(), F.abs(en - an))
    return both.select(*keys, "path", output_root(F.col("path")).alias("root"), reason.alias("reason"), error.alias("abs_error"), F.when(en != 0, error / F.abs(en)).alias("rel_error"))


def parity_cases(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """Per case: passed, mismatches, largest errors and the first reason by path."""
    bad = F.col("reason").isNotNull()
    return leaves.groupBy(*keys).agg(F.bool_and(~bad).alias("passed"), F.count_if(bad).alias("mismatches"), F.max("abs_error").alias("max_abs_error"), F.max("rel_error").alias("max_rel_error"), F.min_by("reason", F.when(bad, F.col("path"))).alias("first_reason"), F.min(F.when(bad, F.col("path"))).alias("first_path"))


def per_output(leaves: DataFrame) -> DataFrame:
    """Per output root: leaves, mismatches and largest errors."""
    return leaves.groupBy("root").agg(F.count(F.lit(1)).alias("leaves"), F.count_if(F.col("reason").isNotNull()).alias("mismatches"), F.max("abs_error").alias("max_abs_error"), F.max("rel_error").alias("max_rel_error"))


def worst_divergences(cases: DataFrame, keys: list[str], top: int = 100) -> DataFrame:
    return cases.where("NOT passed").orderBy(F.desc_nulls_last("max_abs_error"), F.desc_nulls_last("max_rel_error"), *keys).limit(top)


def first_divergence(reference: DataFrame, candidate: DataFrame, by: list[str], sequence: str = "seq", atol: float = 1e-6, rtol: float = 1e-5) -> DataFrame:
    """The first record of two sequences that differs in name or beyond the tolerance, per group."""
    r = reference.select(*by, sequence, F.col("name").alias("r_name"), F.col("value").alias("r_value"))
    c = candidate.select(*by, sequence, F.col("name").alias("c_name"), F.col("value").alias("c_value"))
    reason = F.when(F.col("c_name").isNull(), "missing").when(F.col("r_name").isNull(), "unexpected").when(F.col("r_name") != F.col("c_name"), "name").when(~within_expected(F.col("r_value"), F.col("c_value"), F.lit(atol), F.lit(rtol)), "value")
    bad = r.join(c, [*by, sequence], "full_outer").withColumn("reason", reason).where("reason IS NOT NULL")
    return bad.groupBy(*by).agg(F.min(sequence).alias(sequence), F.min_by("reason", sequence).alias("reason"))


def schema_profile(df: DataFrame) -> DataFrame:
    """column, type, nulls, rows, nullable, from one pass that counts all columns together."""
    n = F.count(F.lit(1)).alias("rows")
    counts = df.agg(n, *[F.count_if(is_null_like(F.col(f.name), f.dataType)).alias(f"n{i}") for i, f in enumerate(df.schema)])
    cells = [F.struct(F.lit(f.name).alias("column"), F.lit(type_family(f.dataType)).alias("type"), F.col(f"n{i}").alias("nulls")) for i, f in enumerate(df.schema)]
    return counts.select("rows", F.explode(F.array(*cells)).alias("c")).select("c.column", "c.type", "c.nulls", "rows", (F.col("c.nulls") > 0).alias("nullable"))


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)


def table_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """rows and multiset_sha256: the digest of the number of rows and of the sums of the eight 32-bit words of all row
    hashes. The order of rows doesn't matter, repeats do; one aggregation that combines before its shuffle."""
    h = row_hash(df, columns)
    words = [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)").alias(f"w{i}") for i in range(8)]
    sums = df.select(*words).agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(f"w{i}"), F.lit(0)).cast("decimal(38,0)").cast("string").alias(f"w{i}") for i in range(8)])
    return sums.select("rows", F.sha2(F.concat_ws(",", F.col("rows").cast("string"), *[f"w{i}" for i in range(8)]), 256).alias("multiset_sha256"))


def top_mismatches(cells: DataFrame, top: int = 100) -> DataFrame:
    w = Window.partitionBy("kind").orderBy(F.asc_nulls_first("row_idx"), F.asc_nulls_first("column"))
    return cells.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= top).drop("rn_")
