"""All registered queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers the decorated function under ``name``, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add
