"""Line history of versioned documents: columns conv_id, turn, text, a row for each version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lines(versions: DataFrame) -> DataFrame:
    return versions.select("conv_id", "turn", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))


def line_changes(versions: DataFrame) -> DataFrame:
    """conv_id, turn, line with how often it stands in the version (cur) and in the one before (prev).

    Each line is counted for its own version and for the next, in one aggregation keyed by
    document, version and line; so a document with very many versions spreads over all tasks.
    """
    own = lines(versions).select("conv_id", "turn", "line", F.lit(1).alias("c"), F.lit(0).alias("p"))
    last = versions.groupBy("conv_id").agg(F.max("turn").alias("last"))
    before = lines(versions.join(last, "conv_id").where("turn < last").drop("last")).select("conv_id", (F.col("turn") + 1).alias("turn"), "line", F.lit(0).alias("c"), F.lit(1).alias("p"))
    return own.unionByName(before).groupBy("conv_id", "turn", "line").agg(F.sum("c").alias("cur"), F.sum("p").alias("prev"))


def numstat(versions: DataFrame) -> DataFrame:
    up, down = F.greatest(F.col("cur") - F.col("prev"), F.lit(0)), F.greatest(F.col("prev") - F.col("cur"), F.lit(0))
    return line_changes(versions).groupBy("conv_id", "turn").agg(F.sum(up).alias("additions"), F.sum(down).alias("deletions"))


def added(versions: DataFrame) -> DataFrame:
    return line_changes(versions).where("cur > prev").select("conv_id", "turn", "line", (F.col("cur") - F.col("prev")).alias("n"))


def removed(versions: DataFrame) -> DataFrame:
    return line_changes(versions).where("prev > cur").select("conv_id", "turn", "line", (F.col("prev") - F.col("cur")).alias("n"))


def kept(versions: DataFrame) -> DataFrame:
    return line_changes(versions).groupBy("conv_id", "turn").agg(F.sum(F.least("cur", "prev")).alias("n_kept"))


def blame(versions: DataFrame) -> DataFrame:
    """conv_id, line, first_turn: since which version each line of the last one has stood there without a break."""
    last = versions.groupBy("conv_id").agg(F.max("turn").alias("last"))
    island = F.col("turn") - F.row_number().over(Window.partitionBy("conv_id", "line").orderBy("turn"))
    runs = lines(versions).distinct().withColumn("island", island).groupBy("conv_id", "line", "island").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("end"))
    return runs.join(last, "conv_id").where(F.col("end") == F.col("last")).select("conv_id", "line", "first_turn")


def latest(versions: DataFrame, at: int | None = None) -> DataFrame:
    """The last version of each document, or the last not after ``at``."""
    seen = versions if at is None else versions.where(F.col("turn") <= at)
    return seen.groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("x")).select("conv_id", "x.turn", "x.text")


def hash_links(versions: DataFrame) -> DataFrame:
    """conv_id, turn, link: each version's hash bound to that of the version before it."""
    own = F.sha2(F.coalesce("text", F.lit("")), 256)
    hashed = versions.select("conv_id", "turn", own.alias("own"))
    before = F.lag("own", 1, "").over(Window.partitionBy("conv_id").orderBy("turn"))
    return hashed.select("conv_id", "turn", F.sha2(F.concat(before, F.col("own")), 256).alias("link"))


def broken_links(links: DataFrame, versions: DataFrame) -> DataFrame:
    """conv_id, turn of the versions whose recorded link isn't that of their text."""
    now = hash_links(versions).withColumnRenamed("link", "now")
    return links.join(now, ["conv_id", "turn"], "full_outer").where(~F.col("link").eqNullSafe(F.col("now"))).select("conv_id", "turn")


def three_way_merge(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """conv_id, line, status over sets of lines; status: kept, added_ours, added_theirs, added_both, removed_ours, removed_theirs, removed_both."""
    flag = lambda df, n: df.select("conv_id", "line", *[F.lit(int(n == k)).alias(k) for k in "bot"])
    sides = flag(base, "b").unionByName(flag(ours, "o")).unionByName(flag(theirs, "t")).groupBy("conv_id", "line").agg(*[F.max(k).alias(k) for k in "bot"])
    b, o, t = (F.col(k) == 1 for k in "bot")
    status = (
        F.when(b & o & t, "kept").when(b & o, "removed_theirs").when(b & t, "removed_ours").when(b, "removed_both")
        .when(o & t, "added_both").when(o, "added_ours").otherwise("added_theirs")
    )
    return sides.select("conv_id", "line", status.alias("status"))


def conflicts(paragraphs: DataFrame) -> DataFrame:
    """Adds kind and merged to paragraphs of anchor, base, ours, theirs: kind text if both sides changed differently, structural if one deleted what the other changed, else null."""
    b, o, t = F.col("base"), F.col("ours"), F.col("theirs")
    ours, theirs, same = ~o.eqNullSafe(b), ~t.eqNullSafe(b), o.eqNullSafe(t)
    clash = ours & theirs & ~same
    kind = F.when(clash & (o.isNull() | t.isNull()), "structural").when(clash, "text")
    return paragraphs.withColumns({"kind": kind, "merged": F.when(clash, None).when(ours, o).otherwise(t)})


def resolve(conflicted: DataFrame) -> DataFrame:
    """Applies column choice (ours, theirs, edit) and edit to what conflicts() left open."""
    chosen = F.when(F.col("choice") == "ours", F.col("ours")).when(F.col("choice") == "theirs", F.col("theirs")).when(F.col("choice") == "edit", F.col("edit"))
    return conflicted.withColumn("merged", F.when(F.col("kind").isNull(), F.col("merged")).otherwise(chosen))
