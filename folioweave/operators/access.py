"""Roles, inheritance and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Drive roles and the repository roles they give; any other role is a guest.
ROLE_MAP = {"owner": "maintainer", "writer": "developer", "commenter": "reporter", "reader": "guest"}
RANKS = {"guest": 1, "reporter": 2, "developer": 3, "maintainer": 4}
#: Market segments as drive roles; the fifth has none.
SEGMENT_ROLE = {"AUTOMOBILE": "owner", "BUILDING": "writer", "FURNITURE": "commenter", "HOUSEHOLD": "reader"}


def lookup(c: Column, table: dict[str, str | int], default: str | int) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(default))


def repository_role(drive_role: Column) -> Column:
    return lookup(drive_role, ROLE_MAP, "guest")


def segment_role(segment: Column) -> Column:
    return lookup(segment, SEGMENT_ROLE, "unknown")


def roles(customers: DataFrame) -> DataFrame:
    return customers.select("c_custkey", repository_role(segment_role(F.col("c_mktsegment"))).alias("role"))


def unmapped(customers: DataFrame) -> DataFrame:
    return customers.where(~F.coalesce(F.col("c_mktsegment").isin(*SEGMENT_ROLE), F.lit(False))).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def folder_edges(region: DataFrame, nation: DataFrame, customer: DataFrame) -> DataFrame:
    """node, parent of a tree of three levels."""
    up = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return nation.select(up("n", "n_nationkey").alias("node"), up("r", "n_regionkey").alias("parent")).unionByName(customer.select(up("c", "c_custkey").alias("node"), up("n", "c_nationkey").alias("parent")))


def ancestors(edges: DataFrame, max_depth: int = 100) -> DataFrame:
    """node, ancestor, depth of a forest by joining upwards until no parent is left."""
    edges = cut(edges)
    level, out = edges.select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")), None
    for depth in range(1, max_depth + 1):
        out = level if out is None else out.unionByName(level)
        step = edges.select(F.col("node").alias("ancestor"), F.col("parent").alias("above"))
        level = cut(level.join(step, "ancestor").select("node", F.col("above").alias("ancestor"), F.lit(depth + 1).alias("depth")))
        if level.isEmpty():
            return out
    raise ValueError(f"deeper than {max_depth} or cyclic")


def reachable(edges: DataFrame) -> DataFrame:
    """a, b for every node b that can be reached from a; cycles are allowed.

    Each round adds the paths that end in what the round before found first; frames are
    checkpointed, so the plan doesn't grow with the length of paths.
    """
    edges = cut(edges.select("a", "b").distinct())
    seen = front = edges
    step = edges.select(F.col("a").alias("b"), F.col("b").alias("c"))
    while True:
        front = cut(front.join(step, "b").select("a", F.col("c").alias("b")).distinct().join(seen, ["a", "b"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))


def effective_rank(customers: DataFrame, nation: DataFrame) -> DataFrame:
    """The stronger of a customer's own role and the one its nation inherits to it."""
    given = nation.select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") % 4 + 1).cast("long").alias("inherited"))
    own = lookup(repository_role(segment_role(F.col("c_mktsegment"))), RANKS, 1).cast("long")
    return customers.join(given, "c_nationkey", "left").select("c_custkey", F.greatest(own, F.coalesce("inherited", F.lit(0))).cast("long").alias("role_rank"))


def drift(drive: DataFrame, git: DataFrame) -> DataFrame:
    """side and row of what stands on one side alone."""
    return drive.exceptAll(git).withColumn("side", F.lit("drive")).unionByName(git.exceptAll(drive).withColumn("side", F.lit("git")))
