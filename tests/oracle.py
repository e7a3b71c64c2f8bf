"""Compares a query with its SQL twin."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import DataFrame

from folioweave.session import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(x: object) -> str:
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x + 0.0:.9g}"
    return str(x)


def rows(names: list[str], found: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


def same(df: DataFrame, c: duckdb.DuckDBPyConnection, sql: str) -> None:
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    want = rows(names, r.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want), f"{len(got)} rows, SQL has {len(want)}"
    assert got == want, next((a, b) for a, b in zip(got, want, strict=True) if a != b)
