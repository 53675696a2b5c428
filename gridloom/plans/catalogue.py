"""Queries of the workbook operators over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans import aggregates, books, bundles, gates, precedents, scalars, sheets, similar

Query = Callable[[SparkSession, str], DataFrame]
_PARTS = (scalars, aggregates, sheets, precedents, similar, gates, bundles, books)


def queries() -> dict[str, Query]:
    """Every query by name."""
    return {k: v for part in _PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query."""
    return {k: v for part in _PARTS for k, v in part.SQL.items()}
