"""Commit records and their index: orders are commits, their line items the changed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, stored
from .commits import by_time, messages

#: Return flags as file states.
STATUS_OF = {"A": "added", "N": "modified", "R": "removed"}
ISO, SHOWN = "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd hh:mm a"
DIMENSIONS = 16


def status(flag: Column) -> Column:
    out = F.lit("modified")
    for k, v in STATUS_OF.items():
        out = F.when(flag == k, v).otherwise(out)
    return out


def changed_files(items: DataFrame) -> DataFrame:
    """l_orderkey with path, status, additions and deletions of each file of a commit."""
    path = F.concat(F.lit("clause-"), F.col("l_partkey").cast("string"), F.lit(".md"))
    return items.select("l_orderkey", path.alias("path"), status(F.col("l_returnflag")).alias("status"), F.col("l_quantity").cast("int").alias("additions"), F.col("l_linenumber").cast("int").alias("deletions"))


def commit_hash(key: Column) -> Column:
    return F.sha2(key.cast("string"), 256)


def records(orders: DataFrame, items: DataFrame) -> DataFrame:
    """The commit record: hash, message, author, timestamp, files, changes, embedding (null until indexed).

    A record holds all files of its commit, so it is as long as the commit is.
    """
    files = changed_files(items)
    own = lambda s: F.sort_array(F.collect_set(F.when(F.col("status") == s, F.col("path"))))
    sections = F.sort_array(F.collect_set(F.concat(F.lit("section-"), F.col("deletions").cast("string"))))
    gathered = files.groupBy("l_orderkey").agg(F.collect_list(F.struct("path", "status", "additions", "deletions")).alias("files"), F.struct(own("added").alias("added"), own("removed").alias("removed"), sections.alias("sections")).alias("changes"))
    none = F.array().cast("array<string>")
    made = orders.select("o_orderkey", commit_hash(F.col("o_orderkey")).alias("hash"), F.col("o_custkey").cast("string").alias("author"), F.col("o_orderdate").alias("timestamp")).join(messages(orders), "o_orderkey")
    joined = made.join(gathered, made["o_orderkey"] == gathered["l_orderkey"], "left")
    empty = F.struct(none.alias("added"), none.alias("removed"), none.alias("sections"))
    nothing = F.array().cast("array<struct<path:string,status:string,additions:int,deletions:int>>")
    return joined.select("hash", "message", "author", "timestamp", F.coalesce("files", nothing).alias("files"), F.coalesce("changes", empty).alias("changes"), F.lit(None).cast("array<float>").alias("embedding"))


def summary(found: DataFrame) -> DataFrame:
    """A record in one flat row."""
    total = lambda c: F.aggregate("files", F.lit(0).cast("long"), lambda s, f: s + f[c])
    joined = lambda c: F.array_join(F.col("changes")[c], ",")
    return found.select(
        "hash", F.substring("hash", 1, 14).alias("short_hash"), "message", "author", F.date_format("timestamp", ISO).alias("ts"),
        F.size("files").cast("long").alias("n_files"), total("additions").alias("additions"), total("deletions").alias("deletions"),
        joined("added").alias("added"), joined("removed").alias("removed"), joined("sections").alias("sections"),
    )


def flat_files(found: DataFrame) -> DataFrame:
    """hash, path, status, additions, deletions: a row for each file of each record."""
    return found.select("hash", F.inline("files"))


def modified_paths(files: DataFrame, wanted: str = "modified") -> DataFrame:
    return files.where(F.col("status") == wanted).groupBy("path").agg(F.count("*").alias("n"), F.sum("additions").alias("additions"))


def embed_text(found: DataFrame) -> DataFrame:
    """hash, message, text that is embedded: message and difference; a record without a message has none."""
    sign = lambda c, s: F.transform(F.col("changes")[c], lambda x: F.concat(F.lit(s), x))
    diff = F.array_join(F.concat(sign("removed", "-"), sign("added", "+")), " ")
    return found.where("message is not null").select("hash", "message", F.concat_ws(" ", "message", diff).alias("embed_text"), "changes")


def hashed_vector(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Counts of words by hash, scaled to unit length: a stand-in for a model's embedding."""
    places = F.transform(F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != ""), lambda w: F.crc32(w) % dimensions)
    counts = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.size(F.filter(places, lambda p: p == d)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float"))


def index_entries(found: DataFrame) -> DataFrame:
    """hash, message, embedding, changes: what the search index stores of each commit."""
    return embed_text(found).select("hash", "message", hashed_vector(F.col("embed_text")).alias("embedding"), "changes")


def index_on_commit(path: str) -> Callable[[DataFrame], None]:
    """A hook that appends the index entries of new commit records to ``path``."""
    return lambda found: index_entries(found).write.mode("append").parquet(path)


def append(found: DataFrame, path: str, repo: Column) -> None:
    """Appends records to a history laid out by repository, so that reading one prunes the others.

    Adaptive execution splits a repository that is too large for one task.
    """
    found.withColumn("repo", repo).hint("rebalance", "repo").write.mode("append").partitionBy("repo").parquet(path)


def captured(orders: DataFrame) -> DataFrame:
    """Metadata that a commit gets without being asked: author, time and the author's version number."""
    return orders.select("o_orderkey", F.col("o_custkey").alias("author"), F.date_format("o_orderdate", ISO).alias("ts"), F.row_number().over(by_time()).cast("long").alias("version"))


def shown_times(orders: DataFrame) -> DataFrame:
    """o_orderkey, the time as ISO text, read back from it, and as shown to users."""
    iso = F.date_format("o_orderdate", ISO)
    return orders.select("o_orderkey", iso.alias("iso"), F.to_timestamp_ntz(iso, F.lit(ISO)).alias("parsed"), F.date_format("o_orderdate", SHOWN).alias("shown"))


# History as a graph ------------------------------------------------------------------


def parents(orders: DataFrame) -> DataFrame:
    """child, parent: the author's commit before, and for a final commit also the last review before it, which it merges."""
    w = by_time()
    review = F.last(F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    each = orders.select(F.col("o_orderkey").alias("child"), F.lag("o_orderkey").over(w).alias("p1"), F.when(F.col("o_orderstatus") == "F", review).alias("p2"))
    return each.select("child", F.explode(F.array_distinct(F.array_compact(F.array("p1", "p2")))).alias("parent"))


def ancestry(edges: DataFrame) -> DataFrame:
    """child, ancestor, distance: the fewest steps from each commit to each ancestor.

    Paths double in length each round, so a history of n commits in a row takes log n rounds. A path
    of up to twice ``span`` steps is one of just ``span`` and the rest, so a round joins only the pairs
    of that distance with those found; each pair is stored once, by the round that found it.
    """
    found = fresh = stored(edges.groupBy(F.col("child"), F.col("parent").alias("ancestor")).agg(F.lit(1).cast("long").alias("distance")))
    span = 1
    while True:
        far = fresh.where(F.col("distance") == span).select("child", F.col("ancestor").alias("middle"))
        if far.isEmpty():
            return found
        # Dealt out by child once: the same exchange serves the join and the minimum.
        known = found.repartition("child")
        on = known.select(F.col("child").alias("middle"), "ancestor", (F.col("distance") + span).alias("distance"))
        longer = far.join(on, "middle").select("child", "ancestor", "distance")
        fresh = stored(known.unionByName(longer.repartition("child")).groupBy("child", "ancestor").agg(F.min("distance").alias("distance")).where(F.col("distance") > span))
        found, span = found.unionByName(fresh), 2 * span


def condensed(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """child, parent, steps of the history without the commits of one parent and one child, but for those of ``kept`` (column commit).

    Runs of such commits become one edge. They are followed by doubling, so a run of n takes log n rounds,
    and jumps that reach their run's end take no part in later ones.
    """
    e = cut(edges.select("child", "parent").distinct())
    one = lambda end: e.groupBy(F.col(end).alias("commit")).agg(F.count("*").alias("n")).where("n = 1").select("commit")
    inner = one("child").join(one("parent"), "commit").join(kept.select("commit"), "commit", "left_anti")
    jumps = cut(e.join(inner.withColumnRenamed("commit", "child"), "child").select(F.col("child").alias("commit"), F.col("parent").alias("to"), F.lit(1).cast("long").alias("steps")))
    moving, settled = jumps, jumps.limit(0)
    while not moving.isEmpty():
        all_ = settled.withColumn("last", F.lit(True)).unionByName(moving.withColumn("last", F.lit(False)))
        on = all_.select(F.col("commit").alias("to"), F.col("to").alias("further"), F.col("steps").alias("more"), "last")
        moved = cut(moving.join(on, "to", "left").select("commit", F.coalesce("further", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("last", F.lit(True)).alias("last")))
        settled, moving = settled.unionByName(moved.where("last").drop("last")), moved.where("not last").drop("last")
    jumps = settled
    ends = e.join(jumps.select(F.col("commit").alias("child")), "child", "left_anti").join(jumps.withColumnRenamed("commit", "parent"), "parent", "left")
    return ends.groupBy("child", F.coalesce("to", "parent").alias("parent")).agg(F.min(F.coalesce("steps", F.lit(0)) + 1).alias("steps"))


def merge_bases(heads: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds base and steps to ``heads`` (a, b): the common ancestor, perhaps one of them, of fewest steps to both, the smaller on a tie.

    Both heads walk up the condensed history at once. A commit met by both bounds the steps, and
    no walk goes on beyond that bound, so what is read is what lies about as far as the base, not
    the history. A base has two children or is a head: another's only child would be nearer to both.
    A round meets only what it newly reached, and pairs whose walks have ended leave the rounds.
    """
    pairs = cut(heads.select("a", "b").distinct())
    up = cut(condensed(edges, pairs.select(F.col("a").alias("commit")).union(pairs.select("b")).distinct())).select(F.col("child").alias("commit"), "parent", F.col("steps").alias("more"))
    start = lambda end: pairs.select("a", "b", F.col(end).alias("commit"), F.lit(end).alias("side"), F.lit(0).cast("long").alias("steps"))
    reached = front = cut(start("a").unionByName(start("b")))
    best = pairs.select("a", "b", F.lit(None).cast("struct<steps: bigint, base: bigint>").alias("best"))
    ended = None
    while True:
        other = reached.select("a", "b", "commit", F.col("side").alias("from"), F.col("steps").alias("rest"))
        met = front.join(other, ["a", "b", "commit"]).where("side <> from").select("a", "b", F.struct((F.col("steps") + F.col("rest")).alias("steps"), F.col("commit").alias("base")).alias("best"))
        best = cut(best.unionByName(met).groupBy("a", "b").agg(F.min("best").alias("best")))
        open_ = best.select("a", "b", F.col("best.steps").alias("most"))
        further = front.join(up, "commit").select("a", "b", F.col("parent").alias("commit"), "side", "steps", (F.col("steps") + F.col("more")).alias("on"))
        # At just the bound the other head itself may be met, and be smaller than the base found.
        nearer = further.join(open_, ["a", "b"]).where("most is null or (steps < most and on <= most)").groupBy("a", "b", "commit", "side").agg(F.min("on").alias("steps"))
        known = reached.withColumnRenamed("steps", "known")
        front = cut(nearer.join(known, ["a", "b", "commit", "side"], "left").where("known is null or steps < known").drop("known"))
        walking = front.select("a", "b").distinct()
        still = best.join(walking, ["a", "b"], "left_anti")
        ended = still if ended is None else ended.unionByName(still)
        if front.isEmpty():
            return heads.select("a", "b").join(ended, ["a", "b"], "left").select("a", "b", F.col("best.base").alias("base"), F.col("best.steps").alias("steps"))
        best = best.join(walking, ["a", "b"], "left_semi")
        reached = cut(reached.join(walking, ["a", "b"], "left_semi").unionByName(front).groupBy("a", "b", "commit", "side").agg(F.min("steps").alias("steps")))


def heads(orders: DataFrame) -> DataFrame:
    """a, b of each author: the last draft and the last review."""
    last = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.struct("o_orderdate", "o_orderkey")))["o_orderkey"]
    return orders.groupBy("o_custkey").agg(last("O").alias("a"), last("P").alias("b")).where("a is not null and b is not null").select("a", "b")
