"""Queries and their SQL, by name; SQL is put together from named parts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PARTS: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL for the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def whole(sql: str) -> str:
    """``sql`` behind the named parts that it uses, in order of definition."""
    used, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name, part in PARTS.items():
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                todo.append(part)
    parts = [f"{n} AS ({p})" for n, p in PARTS.items() if n in used]
    return (f"WITH {', '.join(parts)} {sql}" if parts else sql).strip()
