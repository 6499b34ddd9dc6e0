"""Registry of the queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.plans import documents, fixtures, scholarly, tables

_ALL = documents.QUERIES | tables.QUERIES | scholarly.QUERIES | fixtures.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
