"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut as _cut
from ..session import shared_folder

__all__ = ["connected_components", "cut", "lower_ascii", "maybe_broadcast", "once", "stored", "table"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z alone; ``lower`` would also fold other alphabets."""
    return F.translate(c, UPPER, LOWER)


def once(df: DataFrame, **made: Column) -> DataFrame:
    """df with new columns that are computed once for each row, however often they are used.

    Spark may repeat an expression at each of its uses; a generator of one row stops that.
    """
    kept = [df[c] for c in df.columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What runs inside removes its shuffle files when it has run, and not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a reliable checkpoint, which needs the shuffles before it no more."""
    with shuffles_removed(df.sparkSession):
        # A frame of its own, as df may be used again and Spark reads the setting when a frame is made.
        return _cut(df.select("*"))


def stored(df: DataFrame) -> DataFrame:
    """The frame written as Parquet to the shared checkpoint folder, and read again."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def maybe_broadcast(df: DataFrame, rows: int, most: int = 10_000) -> DataFrame:
    """Hints a broadcast only if the counted rows stay within ``most``; otherwise the join shuffles."""
    return F.broadcast(df) if rows <= most else df


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Columns a, b (undirected links) to node, component, with the smallest node as component.

    Distributed union-find by alternating large and small stars: each round hangs the
    neighbours of a node on the smallest of them, until nothing changes. A star's centre
    may hold many links, so minima are pre-aggregated and the joins back are plain
    sort-merge joins, whose large partitions adaptive execution splits. Nodes without a
    link to another node are absent from the result. Null ends are ignored.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
