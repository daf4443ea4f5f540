"""Failure signatures: normalised, grouped, matched; envelopes and tracebacks in output text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.redaction import normalise_message

#: What makes two failures the same; the hash of a traceback does not.
SIGNATURE = ("kind", "error_type", "normalized_message", "chain", "phase", "module", "operation", "top_frame")


#: Modules of the language's own exceptions, under the names that they are reported by.
OWN_MODULES = ("", "builtins", "exceptions", "__builtin__")


def type_parts(error_type: Column) -> tuple[Column, Column]:
    """(module, short name); the language's own exceptions have the module ''."""
    name = F.element_at(F.split(error_type, r"\."), -1)
    module = F.when(F.length(error_type) > F.length(name), F.substring(error_type, F.lit(1), F.length(error_type) - F.length(name) - 1)).otherwise("")
    return F.when(module.isin(*OWN_MODULES), "").otherwise(module), name


def signatures(failures: DataFrame) -> DataFrame:
    """Adds normalized_message; error_type is its module and name, without a module for the language's own."""
    module, name = type_parts(F.col("error_type"))
    return failures.withColumns({"normalized_message": normalise_message(F.col("message")), "error_type": F.when(module == "", name).otherwise(F.concat_ws(".", module, name))})


def groups(failures: DataFrame) -> DataFrame:
    """The signature's columns and failures, one row per group; context columns that are absent are left out.

    Types of one name from different modules are different types.
    """
    keys = [c for c in SIGNATURE if c in failures.columns or c == "normalized_message"]
    return signatures(failures).groupBy(*keys).agg(F.count(F.lit(1)).alias("failures"))


def matches(expected: DataFrame, observed: DataFrame, context: tuple[str, ...] = ("phase", "module", "operation", "top_frame")) -> DataFrame:
    """expected_id, observed_id of failures with the same kind and normalised message, types of the same name whose
    modules agree or of which one is the language's own, and agreeing context columns where the expected one states
    them.

    Group both sides by their signature first where failures repeat: the result has a row per matching pair.
    """
    side = lambda df, p: signatures(df).withColumns(dict(zip((f"{p}_package", "type_name"), type_parts(F.col("error_type")), strict=True)))
    e = side(expected, "e").select(F.col("id").alias("expected_id"), "kind", "type_name", "e_package", "normalized_message", *[F.col(c).alias(f"e_{c}") for c in context])
    o = side(observed, "o").select(F.col("id").alias("observed_id"), "kind", "type_name", "o_package", "normalized_message", *context)
    agree = (F.col("e_package") == F.col("o_package")) | (F.col("e_package") == "") | (F.col("o_package") == "")
    for c in context:
        agree = agree & (F.col(f"e_{c}").isNull() | F.col(f"e_{c}").eqNullSafe(F.col(c)))
    return e.join(o, ["kind", "type_name", "normalized_message"]).where(agree).select("expected_id", "observed_id")


def from_traceback(text: Column) -> tuple[Column, Column]:
    """(error type, message) of the last line of a traceback that looks like an exception."""
    last = F.try_element_at(F.filter(F.split(F.rtrim(text), "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w.]*(Error|Exception|Interrupt|Exit|Warning)\b")), F.lit(-1))
    return F.nullif(F.regexp_extract(last, r"^([A-Za-z_][\w.]*)", 1), F.lit("")), F.trim(F.regexp_extract(last, r"^[A-Za-z_][\w.]*:?\s*(.*)$", 1))


def last_envelope(text: Column) -> Column:
    """The last line that is a JSON object with a failure, or null."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.startswith("{") & F.get_json_object(x, "$.failure.error_type").isNotNull())
    return F.try_element_at(lines, F.lit(-1))
