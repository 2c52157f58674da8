"""Registry of runnable queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegauge.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with its equivalent SQL when there is one."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(configure(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql.strip()
        return fn
    return register


def load_all() -> None:
    from tidegauge.queries import (  # noqa: F401
        aggregation, alignment, forecasting, learning, missing, ordering, projection, scalars,
        sources, statistics, streams, windows,
    )
