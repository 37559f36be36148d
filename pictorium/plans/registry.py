"""The registry of named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import Views, with_views

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Views`; ``sql`` may name views."""

    def put(f: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql:
            SQL[name] = with_views(sql)
        return f

    return put


def add(name: str, f: Callable[[Views], DataFrame], sql: str | None = None) -> None:
    query(name, sql)(f)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, sf_dir, f=f: f(Views(spark, sf_dir))) for n, f in QUERIES.items()}
