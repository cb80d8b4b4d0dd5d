"""Queries over the test tables, by name, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def load() -> None:
    from . import drive_queries, edit_queries, evidence_queries, interval_queries, library_queries, more_queries, object_queries, scalar_queries, series_queries  # noqa: F401
