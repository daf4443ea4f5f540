"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, exact_dedup, language_id, line_dedup, lm_scoring, packing, pii, simhash, token_shards, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id.op1_language_id,
    "op2_pack": packing.op2_pack,
    "op3_simhash": simhash.op3_simhash,
    "op4_pii": pii.op4_pii,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_token_shards": token_shards.op8_token_shards,
    "op9_warc": warc.op9_warc,
    "op10_lm_score": lm_scoring.op10_lm_score,
}

ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": line_dedup.ORACLE_SQL,
    "op6_exact_dedup": exact_dedup.ORACLE_SQL,
    "op7_decontamination": decontamination.ORACLE_SQL,
    "op9_warc": warc.ORACLE_SQL,
}
