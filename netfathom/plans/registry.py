"""Registered queries: each operator on the mapped tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import domain

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name. ``sql`` continues the common table expressions of the domain: either
    ``SELECT ...`` or ``, more AS (...) SELECT ...``."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH RECURSIVE {domain.SQL} {sql}"
        return f

    return add
