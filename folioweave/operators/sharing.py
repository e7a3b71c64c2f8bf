"""Drive permissions along the folder tree, and locks over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import seconds
from .access import RANKS, ancestors, lookup, repository_role, segment_role

LOCK, RELEASE, EDIT = "signup", "purchase", "click"
LOCK_HOURS = 12


def email(name: Column) -> Column:
    return F.concat(F.lower(F.replace(name, F.lit("#"), F.lit("."))), F.lit("@firm.example"))


def grants(customer: DataFrame, supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """folder, email, drive_role: clients on their own folder, a manager on each nation's and each region's."""
    own = customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("folder"), email(F.col("c_name")).alias("email"), segment_role(F.col("c_mktsegment")).alias("drive_role"))
    first = supplier.groupBy("s_nationkey").agg(F.min(F.struct("s_suppkey", "s_name")).alias("x")).select("s_nationkey", "x.s_suppkey", "x.s_name")
    on_nation = first.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("folder"), email(F.col("s_name")).alias("email"), F.lit("writer").alias("drive_role"))
    placed = first.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.min(F.struct("s_suppkey", "s_name")).alias("x"))
    on_region = placed.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("folder"), email(F.col("x.s_name")).alias("email"), F.lit("owner").alias("drive_role"))
    return own.unionByName(on_nation).unionByName(on_region)


def effective(given: DataFrame, edges: DataFrame) -> DataFrame:
    """folder, email, role, inherited: of the roles on a folder and on all folders above it the strongest counts.

    inherited is true if no grant on the folder itself gives that role.
    """
    ranked = given.select("folder", "email", lookup(repository_role(F.col("drive_role")), RANKS, 1).alias("rank"))
    above = ancestors(edges).select(F.col("node").alias("folder"), "ancestor", F.lit(True).alias("inherited"))
    below = above.join(ranked.withColumnRenamed("folder", "ancestor"), "ancestor").select("folder", "email", "rank", "inherited")
    every = ranked.withColumn("inherited", F.lit(False)).unionByName(below)
    best = every.groupBy("folder", "email").agg(F.max(F.struct("rank", (~F.col("inherited")).alias("own"))).alias("x"))
    name = F.lit(None).cast("string")
    for role, rank in RANKS.items():
        name = F.when(F.col("x.rank") == rank, role).otherwise(name)
    return best.select("folder", "email", name.alias("role"), (~F.col("x.own")).alias("inherited"))


def visibility(folders: DataFrame, shared: DataFrame) -> DataFrame:
    """node and visibility: as shared (folder, visibility), private where nothing is said."""
    met = folders.join(shared.withColumnRenamed("folder", "node"), "node", "left")
    return met.select("node", F.coalesce("visibility", F.lit("private")).alias("visibility"))


def tracked(docs: DataFrame, known: DataFrame) -> DataFrame:
    seen = known.select("doc_id").distinct().withColumn("seen", F.lit(True))
    return docs.join(seen, "doc_id", "left").select("doc_id", F.when(F.col("seen"), "tracked").otherwise("untracked").alias("status"))


# Locks: events of one document by its users, of whom five share it --------------------------


def document(user: Column) -> Column:
    return F.floor(user / 5)


def locks_in_force(events: DataFrame, hours: int = LOCK_HOURS) -> DataFrame:
    """event_id, doc, lock_event_id, holder, expires: the lock that an event meets, if any.

    Of the document's locks and releases strictly before the event, the last one counts: a
    lock that has not run out is in force. One document's events stand in one task.
    """
    before = Window.partitionBy("doc").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("event_type").isin(LOCK, RELEASE), F.struct("event_id", "user_id", "ts", "event_type"))
    e = events.withColumn("doc", document(F.col("user_id"))).withColumn("x", F.last(mark, ignorenulls=True).over(before))
    expires = F.col("x.ts") + F.expr(f"INTERVAL {hours} HOURS")
    live = (F.col("x.event_type") == LOCK) & (F.col("ts") <= expires)
    return e.select("event_id", "doc", *[F.when(live, c).alias(n) for n, c in (("lock_event_id", F.col("x.event_id")), ("holder", F.col("x.user_id")), ("expires", expires))])


def holder_changes(events: DataFrame) -> DataFrame:
    """doc, event_id, previous, holder where a document's lock goes to another user than before."""
    w = Window.partitionBy("doc").orderBy("ts", "event_id")
    taken = events.where(F.col("event_type") == LOCK).withColumn("doc", document(F.col("user_id"))).withColumn("previous", F.lag("user_id").over(w))
    return taken.where("previous is not null and previous <> user_id").select("doc", "event_id", "previous", F.col("user_id").alias("holder"))


def join_queue(events: DataFrame) -> DataFrame:
    """doc, event_id, place: the edits that wait for a release stand in a queue that each release empties."""
    w = Window.partitionBy("doc").orderBy("ts", "event_id")
    e = events.where(F.col("event_type").isin(EDIT, RELEASE)).withColumn("doc", document(F.col("user_id")))
    e = e.withColumn("round", F.sum((F.col("event_type") == RELEASE).cast("int")).over(w))
    place = F.row_number().over(Window.partitionBy("doc", "round").orderBy("ts", "event_id"))
    return e.where(F.col("event_type") == EDIT).withColumn("place", place.cast("long")).select("doc", "event_id", "place")


def released_within(events: DataFrame, minutes: int = 60) -> DataFrame:
    """request, release: each request with the next release of its document, if that comes within ``minutes``."""
    after = Window.partitionBy("doc").orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    freed = F.when(F.col("event_type") == RELEASE, F.struct("event_id", "ts"))
    e = events.where(F.col("event_type").isin(EDIT, RELEASE)).withColumn("doc", document(F.col("user_id"))).withColumn("next", F.first(freed, ignorenulls=True).over(after))
    return e.where((F.col("event_type") == EDIT) & (F.col("next.ts") <= F.col("ts") + F.expr(f"INTERVAL {minutes} MINUTES"))).select(F.col("event_id").alias("request"), F.col("next.event_id").alias("release"))
