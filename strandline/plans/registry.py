"""Queries by name, each with SQL that an independent engine can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        REGISTRY[f.__name__] = (f, sql)
        return f

    return keep
