"""Pairing of two sides by declared identity, never by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import is_finite


def first_runs(runs: DataFrame, key: str = "run_id", order: str = "arrival") -> DataFrame:
    """Duplicate runs removed, the first to arrive stays."""
    w = Window.partitionBy(key).orderBy(order)
    return runs.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def ambiguity(df: DataFrame, keys: list[str], token: str) -> DataFrame:
    """pairing = missing (no token), ambiguous (the token repeats within keys) or declared; one shuffle."""
    w = Window.partitionBy(*keys, token)
    label = F.when(F.col(token).isNull(), "missing").when(F.count(F.lit(1)).over(w) > 1, "ambiguous").otherwise("declared")
    return df.withColumn("pairing", label)


def paired_observations(baseline: DataFrame, candidate: DataFrame, by: list[str] | None = None, token: str = "token", value: str = "value") -> DataFrame:
    """by..., token, baseline, candidate for identities on both sides.

    A group in which any identity repeats on either side, or is null, gives no pairs at all. Values stay as they
    are, failed ones included. The check is an aggregation joined in, so no group is gathered in one place.
    """
    by = by or []
    keys = [*by, token]
    count = lambda df, n: df.groupBy(*keys).agg(F.first(value).alias(n), F.count(F.lit(1)).alias(f"{n}_n"))
    b, c = count(baseline, "baseline"), count(candidate, "candidate")
    bad = b.select(*by, (F.col("baseline_n").alias("n")), token).unionByName(c.select(*by, F.col("candidate_n").alias("n"), token))
    bad = bad.groupBy(*by).agg(F.max((F.col("n") > 1) | F.col(token).isNull()).alias("bad_"))
    pairs = b.join(c, keys).drop("baseline_n", "candidate_n")
    if by:
        return pairs.join(bad.where("NOT bad_").select(*by), by, "left_semi")
    return pairs.join(F.broadcast(bad.where("NOT bad_")), how="left_semi", on=F.lit(True))


def paired_differences(pairs: DataFrame) -> DataFrame:
    """candidate - baseline where both are finite."""
    finite = pairs.where(is_finite(F.col("baseline")) & is_finite(F.col("candidate")))
    return finite.withColumn("difference", F.col("candidate") - F.col("baseline"))


def pairing_quality(baseline: DataFrame, candidate: DataFrame, by: list[str], token: str = "token", value: str = "value", pairable: str | None = None) -> DataFrame:
    """Data-quality counters per group from one full outer join over pairable rows.

    Rows that can't be paired (a null or repeated token, or pairable false) count as unmatched on their side.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(*by, token)
        ok = F.col(token).isNotNull() & (F.count(F.lit(1)).over(w) == 1)
        if pairable:
            ok = ok & F.col(pairable)
        unique = F.when(ok, F.concat(F.lit("id"), F.col(token).cast("string"))).otherwise(F.concat(F.lit(f"{name}#"), F.monotonically_increasing_id().cast("string")))
        return df.select(*by, unique.alias("t_"), ok.alias(f"{name}_ok"), is_finite(F.col(value)).alias(f"{name}_finite"), F.lit(True).alias(f"{name}_there"))

    joined = side(baseline, "b").join(side(candidate, "c"), [*by, "t_"], "full_outer")
    both = F.col("b_there") & F.col("c_there")
    n = F.count_if
    out = joined.groupBy(*by).agg(
        n("b_there").alias("baseline_observations"),
        n("c_there").alias("candidate_observations"),
        n(both).alias("shared_observations"),
        n(both & F.col("b_finite") & F.col("c_finite")).alias("paired_finite_observations"),
        n(F.col("b_there") & ~F.col("b_finite")).alias("baseline_nonfinite"),
        n(F.col("c_there") & ~F.col("c_finite")).alias("candidate_nonfinite"),
        n(both & ~(F.col("b_finite") & F.col("c_finite"))).alias("shared_nonfinite"),
        n(F.col("b_there") & F.col("c_there").isNull()).alias("unpaired_baseline_observations"),
        n(F.col("c_there") & F.col("b_there").isNull()).alias("unpaired_candidate_observations"),
        n("b_ok").alias("b_pairable"),
        n("c_ok").alias("c_pairable"),
    )
    total = F.col("unpaired_baseline_observations") + F.col("unpaired_candidate_observations")
    return out.withColumns(
        {
            "unpaired_observations": total,
            "candidate_missing": (F.col("candidate_observations") == 0) | ((F.col("unpaired_baseline_observations") > 0) & (F.col("c_pairable") > 0)),
            "baseline_missing": (F.col("baseline_observations") == 0) | ((F.col("unpaired_candidate_observations") > 0) & (F.col("b_pairable") > 0)),
        }
    ).drop("b_pairable", "c_pairable")


def sample_design(baseline: DataFrame, candidate: DataFrame, by: list[str], token: str = "token") -> DataFrame:
    """independent (no identities), incompatible (one side has none), ambiguous (repeats) or stable_identity."""

    def side(df: DataFrame, name: str) -> DataFrame:
        per = df.groupBy(*by, token).agg(F.count(F.lit(1)).alias("n"))
        return per.groupBy(*by).agg(F.max(F.when(F.col(token).isNotNull(), F.col("n") > 1).otherwise(False)).alias(f"{name}_repeats"), F.max(F.col(token).isNull()).alias(f"{name}_none"))

    joined = side(baseline, "b").join(side(candidate, "c"), by, "full_outer")
    b, c = F.coalesce("b_none", F.lit(True)), F.coalesce("c_none", F.lit(True))
    label = F.when(b & c, "independent").when(b | c, "incompatible").when(F.col("b_repeats") | F.col("c_repeats"), "ambiguous").otherwise("stable_identity")
    return joined.select(*by, label.alias("pairing"))


def last_finite(df: DataFrame, keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    """A series' outcome: its last finite value, else (none finite) its last value; partial aggregation only."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(F.coalesce(F.max_by(F.when(is_finite(F.col(value)), F.col(value)), F.when(is_finite(F.col(value)), at)), F.max_by(value, at)).alias("outcome"), F.count(F.lit(1)).alias("observations"), F.count_if(~is_finite(F.col(value))).alias("nonfinite_within"))


def merge_identified(parent: DataFrame, child: DataFrame, key: list[str], pos: str = "pos") -> DataFrame:
    """Keyed upsert: the child's row wins, the place is that of the first appearance."""
    rest = [c for c in parent.columns if c not in (*key, pos)]
    both = parent.withColumn("rank_", F.lit(0)).unionByName(child.withColumn("rank_", F.lit(1)))
    first = F.min_by(pos, F.struct("rank_", pos)).alias(pos)
    return both.groupBy(*key).agg(first, *[F.max_by(c, F.struct("rank_", pos)).alias(c) for c in rest])


def names_of(*sides: DataFrame, name: str = "name", required: Sequence[str] = ()) -> DataFrame:
    """name: all names that any side has or that are required."""
    out = sides[0].sparkSession.createDataFrame([(r,) for r in required], "name string")
    for side in sides:
        out = out.unionByName(side.select(F.col(name).cast("string").alias("name")))
    return out.distinct()


def observation_identity(df: DataFrame, by: list[str], order: list[str], explicit: str, step: str) -> DataFrame:
    """Adds identity and identity_kind: the explicit one, else the step, else the place among the series' rows."""
    place = (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("string")
    kind = F.when(F.col(explicit).isNotNull(), "declared").when(F.col(step).isNotNull(), "step").otherwise("position")
    return df.withColumns({"identity": F.coalesce(F.col(explicit).cast("string"), F.col(step).cast("string"), place), "identity_kind": kind})


def series_identity_kind(df: DataFrame, by: list[str]) -> DataFrame:
    """A series' one kind of identity, or mixed."""
    return df.groupBy(*by).agg(F.when(F.count_distinct("identity_kind") > 1, "mixed").otherwise(F.first("identity_kind")).alias("identity_kind"))


def symmetric_difference(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """key..., side: what only one side has."""
    l, r = left.select(*key).distinct(), right.select(*key).distinct()
    return l.join(r, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(r.join(l, key, "left_anti").withColumn("side", F.lit("unexpected")))
