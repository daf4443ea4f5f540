"""Seeded input generation for parity checks: representative, edge and adversarial values as DataFrames."""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Boundary values of a float input.
EDGE = (0.0, -0.0, 1.0, -1.0, 1e-12, -1e-12, 1e6, -1e6)
NON_FINITE = (float("inf"), float("-inf"), float("nan"))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that is a hash of seed and keys, so it doesn't depend on partitioning."""
    word = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])), 1, 13)
    return F.conv(word, 16, 10).cast("double") / F.lit(float(16**13))


def normal(seed: int, *keys: Column) -> Column:
    u, v = uniform(seed * 2 + 1, *keys), uniform(seed * 2 + 2, *keys)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)


def representative(spark: SparkSession, size: int, count: int = 8, seed: int = 0, low: float = -1.0, high: float = 1.0, distribution: str = "uniform") -> DataFrame:
    """case_id, category, values: constants 0, 1, -1, then seeded draws."""
    cell = {"uniform": lambda i: F.lit(low) + (high - low) * uniform(seed, F.col("id"), i), "normal": lambda i: normal(seed, F.col("id"), i), "lognormal": lambda i: F.exp(normal(seed, F.col("id"), i))}[distribution]
    constant = F.when(F.col("id") == 0, 0.0).when(F.col("id") == 1, 1.0).when(F.col("id") == 2, -1.0)
    values = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.coalesce(constant, cell(i)))
    return spark.range(count).select(F.concat(F.lit("representative-"), F.col("id").cast("string")).alias("case_id"), F.lit("representative").alias("category"), values.alias("values"))


def _constants(spark: SparkSession, size: int, category: str, constants: tuple[float, ...]) -> DataFrame:
    rows = [(f"{category}-{i}", category, [float(v)] * size) for i, v in enumerate(constants)]
    return spark.createDataFrame(rows, "case_id string, category string, values array<double>")


def edge(spark: SparkSession, size: int, include_non_finite: bool = False) -> DataFrame:
    return _constants(spark, size, "edge", EDGE + (NON_FINITE if include_non_finite else ()))


def adversarial(spark: SparkSession, size: int, include_non_finite: bool = True) -> DataFrame:
    out = _constants(spark, size, "adversarial", EDGE + (NON_FINITE if include_non_finite else ()))
    alternating = [("adversarial-alternating", "adversarial", [(-1.0) ** i for i in range(size)]), ("adversarial-near-zero", "adversarial", [1e-30 * (i + 1) for i in range(size)])]
    return out.unionByName(spark.createDataFrame(alternating, out.schema))


def input_cases(spark: SparkSession, size: int, examples: DataFrame | None = None, seed: int = 0, representative_count: int = 8, include_edge: bool = True, include_adversarial: bool = True, include_non_finite: bool = False) -> DataFrame:
    """Examples, then representative, edge and adversarial cases; of equal values the first category stays."""
    parts = [] if examples is None else [examples]
    parts.append(representative(spark, size, representative_count, seed))
    if include_edge:
        parts.append(edge(spark, size, include_non_finite))
    if include_adversarial:
        parts.append(adversarial(spark, size, include_non_finite))
    out = None
    for rank, part in enumerate(parts):
        ranked = part.withColumn("rank_", F.lit(rank))
        out = ranked if out is None else out.unionByName(ranked)
    w = Window.partitionBy(F.to_json("values")).orderBy("rank_", "case_id")
    return out.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_", "rank_")


def constrain(value: Column, constraint: str) -> Column:
    """One number under a constraint: non-negative, integer or categorical."""
    kind = constraint.lower().replace("_", "-")
    if kind in ("non-negative", "nonnegative"):
        return F.abs(value)
    if kind in ("integer", "categorical"):
        return F.bround(value)
    return value


@dataclass(frozen=True)
class InputSpec:
    """What a model's input looks like: a shape whose dynamic dimensions have choices by position or name, a type that
    its numbers are cast to, and constraints on them."""

    shape: tuple[int | str | None, ...]
    dtype: str = "float32"
    choices: Mapping[int | str, Sequence[int]] = field(default_factory=dict)
    constraints: tuple[str, ...] = ()

    def resolve_shape(self, seed: int = 0) -> tuple[int, ...]:
        """A shape with a seeded choice for each dynamic dimension; an unnamed one without choices is 1."""
        draws, out = random.Random(seed), []
        for i, size in enumerate(self.shape):
            allowed = self.choices.get(i) or self.choices.get(str(i)) or (self.choices.get(size) if isinstance(size, str) else None)
            if allowed:
                out.append(int(allowed[draws.randrange(len(allowed))]))
            elif isinstance(size, str):
                raise ValueError(f"the dimension {size} has no choices")
            else:
                out.append(1 if size is None else int(size))
        return tuple(out)

    def apply(self, cases: DataFrame, values: str = "values") -> DataFrame:
        """Cases with their values under the constraints (one-hot: a 1 and zeros) and cast to the type."""
        kinds = {c.lower().replace("_", "-") for c in self.constraints}
        cell = lambda x, i: F.when(i == 0, 1.0).otherwise(0.0) if "one-hot" in kinds else x
        out = F.transform(values, cell)
        under = lambda kind: lambda x: constrain(x, kind)
        for kind in sorted(kinds - {"one-hot"}):
            out = F.transform(out, under(kind))
        types = {"float32": "float", "float64": "double", "int32": "int", "int64": "bigint", "bool": "boolean"}
        if self.dtype not in types:
            raise ValueError(f"no type is called {self.dtype}")
        numbers = F.filter(out, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) if self.dtype.startswith("int") else out
        usable = cases.where(F.size(numbers) == F.size(values))  # a whole number can't be infinite
        return usable.withColumn(values, F.transform(out, lambda x: x.try_cast(types[self.dtype])))


def cases_of(spark: SparkSession, spec: InputSpec, seed: int = 0, **options: Any) -> DataFrame:
    """input_cases of a specification, with their shape."""
    shape = spec.resolve_shape(seed)
    return spec.apply(input_cases(spark, math.prod(shape), seed=seed, **options)).withColumn("shape", F.array(*[F.lit(s) for s in shape]))
