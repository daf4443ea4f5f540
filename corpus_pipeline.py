"""A corpus preparation pipeline over `documents`: the stages in order, each from Parquet to Parquet.

Every stage takes all that its predecessor kept. All but the last return the columns of `documents`. Rows that repeat an
id are judged by their own text each, a null id is an id like any other, a null text is the empty one, other columns are
carried along whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runlens.llm.common import Scratch, scratches
from runlens.llm.decontamination import drop_contaminated
from runlens.llm.exact_dedup import drop_exact_duplicates
from runlens.llm.language_id import keep_identified
from runlens.llm.packing import pack
from runlens.llm.simhash import drop_near_copies


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a sure language; empty texts and texts without letters have none."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest identifier; repeated rows of it, and equal texts that have null ids only,
    all stay."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest identifier; texts that only
    null ids have are compared with none."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ten words of the benchmark, or without a whole item that is shorter."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents, empty ones too, in sequences of 2048 tokens."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Language identification and packing can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`, each one's result written and read again before the next.

    What a stage has left in the shared folder goes as soon as its result is written, and so does that of the stage
    before. The last stage's tables stay, as its result reads them.
    """
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with scratches() as used:
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        for left in used:
            left.drop()
        scratch.drop(*before) if before else None
        before = [name]
    return STAGES[-1][1](spark, docs, sf_dir)
