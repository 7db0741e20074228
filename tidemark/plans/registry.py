"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its DuckDB SQL."""

    def add(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def part(name: str, of: str, *columns: str) -> None:
    """Register some columns of a registered query as a query of its own."""
    whole = QUERIES[of]

    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        return whole(spark, sf_dir).select(*columns)

    fn.__name__, fn.__module__, fn.__doc__ = name, whole.__module__, f"{', '.join(columns)} of {of}."
    query(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[of]})" if of in ORACLE_SQL else None)(fn)
