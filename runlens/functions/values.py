"""Observation values: typed states, identity tokens, score vectors, deltas, tolerances."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, types as T
from pyspark.sql import functions as F

INF = float("inf")

#: Words of a metric's name that mean lower is better, and of a resource's that mean higher is better.
LOWER_IS_BETTER = ("loss", "error", "ece", "brier", "calibration_error", "latency", "runtime", "duration", "time", "memory", "ram", "vram", "throughput_time", "size", "cost")
HIGHER_IS_BETTER_RESOURCE = ("throughput", "utilization", "bandwidth", "samples_per", "items_per")
#: Status words of a parity result.
PASSED_WORDS = ("pass", "passed", "success", "succeeded", "ok")
FAILED_WORDS = ("fail", "failed", "failure", "error", "mismatch")
#: Fixed values: (absolute, relative) tolerance of a precision profile.
PROFILES = {"exact": (0.0, 0.0), "fp64": (1e-12, 1e-9), "fp32": (1e-6, 1e-5), "fp16": (1e-3, 1e-2), "bf16": (2e-2, 2e-2)}


def is_finite(value: Column) -> Column:
    """A number that is neither null nor NaN nor infinite."""
    number = value.try_cast("double")
    return F.coalesce(~F.isnan(number) & (F.abs(number) < F.lit(INF)), F.lit(False))


def observation_state(value: Column, failed: Column | None = None) -> Column:
    """finite, nan, pos_inf, neg_inf, missing or failed."""
    number = value.try_cast("double")
    state = (
        F.when(value.isNull(), "missing").when(number.isNull(), "failed").when(F.isnan(number), "nan").when(number == INF, "pos_inf").when(number == -INF, "neg_inf").otherwise("finite")
    )
    return F.when(F.coalesce(failed, F.lit(False)), "failed").otherwise(state) if failed is not None else state


def finite_or_null(value: Column) -> Column:
    return F.when(is_finite(value), value.try_cast("double"))


def identity_token(value: Column, dtype: T.DataType) -> Column:
    """Canonical JSON of an identity, so that 1, 1.0, "1" and true stay four identities. Null stays null."""
    if isinstance(dtype, T.StringType):
        return F.when(value.isNotNull(), F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))
    if isinstance(dtype, T.BooleanType | T.IntegralType):
        return value.cast("string")
    if isinstance(dtype, T.FractionalType):
        return F.when(value == F.floor(value), F.concat(F.floor(value).cast("string"), F.lit(".0"))).otherwise(value.cast("string"))
    return F.to_json(value)


def argmax(scores: Column) -> Column:
    """Index of the first largest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def confidence(scores: Column) -> Column:
    return F.array_max(scores)


def values_differ(before: Column, after: Column) -> Column:
    return ~before.eqNullSafe(after)


def relative_delta(baseline: Column, candidate: Column) -> Column:
    """(candidate - baseline) / |baseline|; over zero null if equal, else a signed infinity."""
    delta = candidate - baseline
    return F.when(baseline != 0, delta / F.abs(baseline)).when(delta > 0, F.lit(INF)).when(delta < 0, F.lit(-INF))


def _has_word(name: Column, words: Sequence[str]) -> Column:
    return F.regexp_like(F.replace(F.lower(name), F.lit("-"), F.lit("_")), F.lit("(^|_)(" + "|".join(words) + ")(_|$)"))


def metric_higher_is_better(name: Column, known: Mapping[str, bool] | None = None) -> Column:
    """A metric's direction by the words of its name; an explicit direction wins."""
    out = ~_has_word(name, LOWER_IS_BETTER)
    for metric, higher in (known or {}).items():
        out = F.when(name == metric, F.lit(higher)).otherwise(out)
    return out


def resource_higher_is_better(name: Column, known: Mapping[str, bool] | None = None) -> Column:
    out = _has_word(name, HIGHER_IS_BETTER_RESOURCE)
    for resource, higher in (known or {}).items():
        out = F.when(name == resource, F.lit(higher)).otherwise(out)
    return out


def is_null_like(value: Column, dtype: T.DataType) -> Column:
    return value.isNull() | F.isnan(value) if isinstance(dtype, T.FloatType | T.DoubleType) else value.isNull()


def type_family(dtype: T.DataType | str) -> str:
    """integer, number, boolean, datetime, string, or the type's own name."""
    if isinstance(dtype, str):
        dtype = T._parse_datatype_string(dtype)
    for kinds, family in ((T.BooleanType, "boolean"), (T.IntegralType, "integer"), ((T.FractionalType, T.DecimalType), "number"), ((T.DateType, T.TimestampType, T.TimestampNTZType), "datetime"), ((T.StringType, T.CharType, T.VarcharType), "string")):
        if isinstance(dtype, kinds):
            return family
    return dtype.typeName()


def within_symmetric(a: Column, b: Column, atol: float = 0.0, rtol: float = 0.0) -> Column:
    """|a - b| <= atol + rtol * max(|a|, |b|); NaN equals nothing."""
    close = F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.greatest(F.abs(a), F.abs(b))
    return F.when(F.isnan(a) | F.isnan(b), F.lit(False)).when((F.abs(a) == INF) | (F.abs(b) == INF), a == b).otherwise(close)


def within_expected(expected: Column, actual: Column, atol: Column, rtol: Column, nan_equal: bool = False, inf_equal: bool = True) -> Column:
    """|expected - actual| <= atol + rtol * |expected|, with rules for NaN and infinities."""
    nan = F.isnan(expected) | F.isnan(actual)
    inf = (F.abs(expected) == INF) | (F.abs(actual) == INF)
    return (
        F.when(nan, F.isnan(expected) & F.isnan(actual) & F.lit(nan_equal))
        .when(inf, (expected == actual) & F.lit(inf_equal))
        .otherwise(F.abs(expected - actual) <= atol + rtol * F.abs(expected))
    )


def parity_passed(flag: Column, status: Column) -> Column:
    """A boolean result, else what the status word says, else null."""
    word = F.lower(status)
    return F.coalesce(flag, F.when(word.isin(*PASSED_WORDS), True).when(word.isin(*FAILED_WORDS), False))


def output_root(path: Column) -> Column:
    """The named output that an element's path belongs to: $['a'][0] and $.a.b to a; $[3] to $."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"^\$\['([^']*)'\]", 1), F.lit("")), F.nullif(F.regexp_extract(path, r"^\$\.([^.\[]+)", 1), F.lit("")), F.lit("$"))
