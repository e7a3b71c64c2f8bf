"""Locks, sessions, limits, search and reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import seconds
from .quantiles import exact_quantiles


def lock_in_force(events: DataFrame) -> DataFrame:
    """event_id with the last signup (a lock) of the same user strictly before it."""
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    lock = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(before)
    return events.select("event_id", lock.alias("lock_event_id"))


def overlapping(events: DataFrame, minutes: int = 10) -> DataFrame:
    """Pairs of a user's clicks within ``minutes``: an equi-join on time buckets, then the exact test."""
    width = minutes * 60
    e = events.where("event_type = 'click'").select("user_id", "event_id", seconds(F.col("ts")).alias("s")).withColumn("bucket", F.expr(f"s div {width}"))
    a = e.select("user_id", F.col("event_id").alias("a_event"), F.col("s").alias("sa"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    b = e.select("user_id", F.col("event_id").alias("b_event"), F.col("s").alias("sb"), "bucket")
    return a.join(b, ["user_id", "bucket"]).where(f"a_event < b_event and abs(sa - sb) <= {width}").select("a_event", "b_event")


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.groupBy("user_id", w).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def hourly_limit(events: DataFrame, most: int = 2) -> DataFrame:
    hour = F.expr("make_timestamp_ntz(year(ts), month(ts), day(ts), hour(ts), 0, 0)")
    return events.groupBy(hour.alias("hour"), "user_id").agg(F.count("*").alias("n")).withColumn("over", F.col("n") > most)


def audit_cube(events: DataFrame) -> DataFrame:
    return events.withColumn("user_bucket", F.col("user_id") % 10).cube("event_type", "user_bucket").agg(F.count("*").alias("n"))


def distincts(events: DataFrame) -> DataFrame:
    return events.agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("types"))


def success_rate(events: DataFrame) -> DataFrame:
    return events.agg(F.round(F.sum((F.col("event_type") != "error").cast("long")) / F.count("*"), 6).alias("rate"))


def median_value(events: DataFrame) -> DataFrame:
    return exact_quantiles(events, None, "value", {"p50": 0.5}).select(F.round("p50", 6).alias("p50"))


def semantic_top(vectors: DataFrame, k: int = 5, every: int = 50, block: int = 2048) -> DataFrame:
    """q, v, sim: each query's k most similar other vectors by cosine, ties to the smaller id. Every 50th vector is a query.

    Candidates and queries are dealt into blocks, each pair of blocks is one task's matrix
    product, and only a block's k best of each query leave it.
    """
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).where("vec_id is not null and e is not null")
    n, asked = v.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    blocks, groups = max(1, -(-n // block)), max(1, -(-asked // block))
    own = lambda x: F.pmod(F.xxhash64("vec_id"), F.lit(x)).cast("int")
    spread = lambda x: F.explode(F.sequence(F.lit(0), F.lit(x - 1)))
    held = v.select("vec_id", "e", F.size("e").alias("d"), own(blocks).alias("block")).withColumn("part", spread(groups))
    ask = v.where(F.col("vec_id") % every == 0).select("vec_id", "e", F.size("e").alias("d"), own(groups).alias("part")).withColumn("block", spread(blocks))

    def best(key: tuple[pa.Scalar, ...], queries: pa.Table, file: pa.Table) -> pa.Table:
        out = [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())]
        if queries.num_rows and file.num_rows:
            a, b = (np.array(t["e"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(t.num_rows, -1) for t in (queries, file))
            ids, asked_ids = file["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
            norms = np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))
            with np.errstate(invalid="ignore"):
                sim = np.round((a @ b.T) / norms, 4)
            found = [[], [], []]
            for i, q in enumerate(asked_ids):
                at = np.flatnonzero((ids != q) & ~np.isnan(sim[i]))
                at = at[np.lexsort((ids[at], -sim[i, at]))[:k]]
                for x, y in zip(found, (np.full(len(at), q), ids[at], sim[i, at]), strict=True):
                    x.append(y)
            out = [pa.array(np.concatenate(x)) for x in found]
        return pa.table(out, names=["q", "v", "sim"])

    keys = ["d", "block", "part"]
    scored = ask.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(best, "q long, v long, sim double")
    order = Window.partitionBy("q").orderBy(F.desc("sim"), "v")
    return scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("q", "v", "sim")


def review_rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    seen = labels.select("doc_id").distinct().withColumn("seen", F.lit(1))
    return docs.join(seen, "doc_id", "left").agg(F.round(F.count("seen") / F.count("*"), 6).alias("rate"))


#: Printed plan of year, tier, customers, monthly price; and of group, item, cost in thousands.
REVENUE = (
    (1, "hosting", 50, 200), (1, "support", 20, 500),
    (2, "hosting", 200, 250), (2, "support", 100, 600), (2, "enterprise", 10, 2000),
    (3, "hosting", 500, 300), (3, "support", 300, 700), (3, "enterprise", 50, 3000),
)
COSTS = (
    ("infrastructure", "cloud", 15), ("infrastructure", "environments", 10), ("infrastructure", "security", 20), ("infrastructure", "licenses", 8),
    ("legal", "review", 15), ("legal", "setup", 8), ("legal", "marketing", 12), ("legal", "community", 10),
    ("operations", "infrastructure", 50), ("operations", "support", 100), ("operations", "security", 30), ("operations", "business", 20),
)


def revenue_rollup(spark) -> DataFrame:
    rows = spark.createDataFrame(list(REVENUE), "year int, tier string, customers long, price long")
    return rows.rollup("year", "tier").agg(F.sum(F.col("customers") * F.col("price") * 12).alias("total"))


def cost_rollup(spark) -> DataFrame:
    rows = spark.createDataFrame(list(COSTS), "grp string, item string, cost long")
    return rows.rollup("grp").agg(F.sum("cost").alias("total"))
