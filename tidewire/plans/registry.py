"""A table of queries by name; SQL sees the domain tables of sources.domain as common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.domain import DUCK

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, domain: bool = True):
    """Registers a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {DUCK}" + (", " + sql.strip()[5:] if sql.strip().startswith("WITH ") else sql) if domain else sql
        return f

    return put
