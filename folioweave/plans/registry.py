"""Registry of the queries by name and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def on(name: str, tables: str, apply: Callable[..., DataFrame], sql: str | None = None) -> None:
    """Registers ``apply`` of the named tables."""
    _QUERIES[name] = lambda spark, d: apply(*[table(spark, d, t) for t in tables.split()])
    if sql:
        _SQL[name] = sql


def streamed(name: str, run: Query, sql: str | None = None) -> None:
    """Registers a stream that is replayed to its end."""
    _QUERIES[name] = run
    if sql:
        _SQL[name] = sql


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
