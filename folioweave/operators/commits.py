"""Commits: orders stand for commits, their line items for changed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.text import message_is_valid, message_type, seconds

#: Order priorities as commit types.
TYPE_OF = {"1-URGENT": "fix", "2-HIGH": "feat", "3-MEDIUM": "review", "4-NOT SPECIFIED": "draft", "5-LOW": "format"}
DESCRIPTIONS = (("draft", "first wording"), ("review", "comments taken in"), ("feat", "new clauses"), ("fix", "corrected wording"), ("format", "layout changes only"))


def by_time() -> WindowSpec:
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


def commit_type(priority: Column) -> Column:
    out = F.lit("other")
    for k, v in TYPE_OF.items():
        out = F.when(priority == k, v).otherwise(out)
    return out


def timeline(orders: DataFrame) -> DataFrame:
    return orders.select("o_custkey", "o_orderkey", F.row_number().over(by_time()).cast("long").alias("episode"))


def file_totals(orders: DataFrame, files: DataFrame) -> DataFrame:
    sums = files.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("a"), F.count_distinct("l_partkey").alias("n"))
    met = orders.select("o_orderkey").join(sums, orders["o_orderkey"] == sums["l_orderkey"], "left")
    return met.select("o_orderkey", F.coalesce("a", F.lit(0)).cast("long").alias("additions"), F.coalesce("n", F.lit(0)).cast("long").alias("n_files"))


def change_arrays(files: DataFrame) -> DataFrame:
    return files.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set("l_partkey")), ",").alias("paths"))


def gaps(orders: DataFrame) -> DataFrame:
    own = seconds(F.col("o_orderdate"))
    return orders.select("o_custkey", "o_orderkey", (F.lead(own).over(by_time()) - own).alias("gap_seconds"))


def velocity(orders: DataFrame, days: int = 7) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("s").rangeBetween(-days * 86400, 0)
    return orders.select("o_custkey", "o_orderkey", seconds(F.col("o_orderdate")).alias("s")).select("o_custkey", "o_orderkey", F.count("*").over(w).alias("n_7d"))


def weekly_rate(orders: DataFrame) -> DataFrame:
    week = F.date_sub(F.col("o_orderdate").cast("date"), F.weekday("o_orderdate")).alias("week")
    each = orders.select(week, "o_custkey").groupBy("week", "o_custkey").count()
    return each.groupBy("week").agg(F.round(F.sum("count") / F.count("*"), 4).alias("avg_commits"))


def type_pivot(orders: DataFrame) -> DataFrame:
    types = sorted(TYPE_OF.values())
    wide = orders.select("o_custkey", commit_type(F.col("o_orderpriority")).alias("type")).groupBy("o_custkey").pivot("type", types).count()
    return wide.na.fill(0, types)


def type_lookup(orders: DataFrame) -> DataFrame:
    dim = orders.sparkSession.createDataFrame(list(DESCRIPTIONS), "type string, description string")
    counts = orders.groupBy(commit_type(F.col("o_orderpriority")).alias("type")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(dim), "type").select("type", "description", "n")  # five fixed rows


def messages(orders: DataFrame) -> DataFrame:
    """o_orderkey and a message made from the order: well formed, without a type, or too long."""
    kind, key = commit_type(F.col("o_orderpriority")), F.col("o_orderkey").cast("string")
    text = F.when(F.col("o_orderstatus") == "O", F.concat(kind, F.lit(": update clause "), key)).when(F.col("o_orderstatus") == "P", F.concat(F.lit("Updated clause "), key)).otherwise(F.concat(kind, F.lit(": accept every remaining change of the other side in clause "), key))
    return orders.select("o_orderkey", text.alias("message"))


def validity(commit_messages: DataFrame) -> DataFrame:
    m = F.col("message")
    return commit_messages.select("o_orderkey", "message", message_type(m).alias("type"), message_is_valid(m).alias("is_valid"))


def pattern_top(commit_messages: DataFrame, k: int = 10) -> DataFrame:
    counts = commit_messages.groupBy(F.regexp_replace("message", "[0-9]+", "#").alias("pattern")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "pattern").limit(k)


def amendments(orders: DataFrame) -> DataFrame:
    """Commits after a signature (status F) of the same author."""
    before = F.max((F.col("o_orderstatus") == "F").cast("int")).over(by_time().rowsBetween(Window.unboundedPreceding, -1))
    return orders.select("o_custkey", "o_orderkey", (F.coalesce(before, F.lit(0)) == 1).alias("is_amendment"))


def signed_without_review(orders: DataFrame) -> DataFrame:
    first = orders.where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("reviewed"))
    met = orders.where("o_orderstatus = 'F'").join(first, "o_custkey", "left")
    return met.where("reviewed is null or reviewed >= o_orderdate").select("o_orderkey")


def signature_trail(orders: DataFrame) -> DataFrame:
    """o_custkey, o_orderkey, ts, kind, place, amends: reviews, drafts and signatures of an author in one order; what follows a signature amends the last one."""
    part = lambda s, kind: orders.where(F.col("o_orderstatus") == s).select("o_custkey", "o_orderkey", "o_orderdate", F.lit(kind).alias("kind"))
    w = by_time()
    signed = F.last(F.when(F.col("kind") == "signature", F.col("o_orderkey")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    every = part("F", "signature").unionByName(part("P", "review")).unionByName(part("O", "draft"))
    return every.select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("ts"), "kind", F.row_number().over(w).cast("long").alias("place"), signed.alias("amends"))


def keep_last(orders: DataFrame, n: int = 3) -> DataFrame:
    newest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return orders.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= n).select("o_custkey", "o_orderkey")


def without(orders: DataFrame, gone: DataFrame) -> DataFrame:
    """The history left when the authors in ``gone`` (c_custkey) ask for deletion."""
    return orders.join(gone, orders["o_custkey"] == gone["c_custkey"], "left_anti")
