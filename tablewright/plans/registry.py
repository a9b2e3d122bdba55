"""Queries over the test tables and the SQL that has to give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def num(expr: str) -> str:
    """SQL for a double written the short way (12.0 -> 12)."""
    return f"regexp_replace(CAST({expr} AS VARCHAR), '\\.0$', '')"
