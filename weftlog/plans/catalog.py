"""Queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftlog.plans import queries as base
from weftlog.plans import logged, logged_sql, reviewed, reviewed_sql, sql

QUERIES = (*base.QUERIES, *reviewed.QUERIES, *logged.QUERIES)
SQL = sql.SQL | reviewed_sql.SQL | logged_sql.SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
