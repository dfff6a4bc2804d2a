"""All queries of the engine's own operators, with their oracle SQL."""

from tickloom.plans import bar_queries, evaluation_queries, feature_queries, gex_queries, indicator_queries, scalar_queries, source_queries, stream_queries  # noqa: F401
from tickloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
