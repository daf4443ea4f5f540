"""All queries of the plan modules."""

from . import evidence, experiments, extensions, live, models, operations, records, texts
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "evidence", "experiments", "extensions", "live", "models", "operations", "records", "texts"]
