"""Every query of the library by name, with its SQL where SQL can express it."""

from __future__ import annotations

from .plans import chunk_queries, event_queries, retrieval_queries, text_queries
from .plans.registry import QUERIES, SQL, Query, whole

__all__ = ["chunk_queries", "event_queries", "oracle_sql", "queries", "retrieval_queries", "text_queries"]


def queries() -> dict[str, Query]:
    return {name.rstrip("_"): f for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name.rstrip("_"): whole(sql) for name, sql in SQL.items()}
