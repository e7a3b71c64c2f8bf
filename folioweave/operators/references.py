"""References between documents: anchors, resolution, rendering, impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import base_name, bound, html_text, slug
from ..session import cut
from .documents import reference_edges

#: A citation as volume, reporter and page; another grammar can be passed in.
CITATION = r"[0-9]+ [A-Z][A-Za-z.]* [0-9]+"
#: Ids of documents that may be broadcast; more are shuffled.
MOST_BROADCAST = 1_000_000
PLACEHOLDER = r"\{\{([A-Za-z0-9-]+)\}\}"


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1)


def anchors(pages: DataFrame) -> DataFrame:
    """anchor, target, target_host: the first word of each page's notice names a section that others refer to; of equal names the smallest page counts."""
    named = pages.select("page_id", host(F.col("url")).alias("h"), F.regexp_extract("html", '<div class="ad">([^ <]+)', 1).alias("anchor")).where("anchor <> ''")
    return named.groupBy("anchor").agg(F.min(F.struct("page_id", "h")).alias("x")).select("anchor", F.col("x.page_id").alias("target"), F.col("x.h").alias("target_host"))


def resolved(pages: DataFrame) -> DataFrame:
    """page_id, href, target: each reference with the page that it means, null if none."""
    edges = reference_edges(pages).withColumn("anchor", F.regexp_replace("href", "^/", ""))
    return edges.join(anchors(pages), "anchor", "left").select("page_id", "href", "target", "target_host")


def cross_matter(pages: DataFrame) -> DataFrame:
    """page_id, target of references that leave the page's own site."""
    own = pages.select("page_id", host(F.col("url")).alias("own_host"))
    return resolved(pages).where("target is not null").join(own, "page_id").where("own_host <> target_host").select("page_id", "target").distinct()


def impact_of(changed: DataFrame, found: DataFrame) -> DataFrame:
    """target, n_affected: how many other pages refer to each changed page (column target)."""
    met = found.where("target is not null and target <> page_id").join(changed, "target", "left_semi")
    return changed.join(met.groupBy("target").agg(F.count_distinct("page_id").alias("n")), "target", "left").select("target", F.coalesce("n", F.lit(0)).alias("n_affected"))


def long_pages(pages: DataFrame, least: int) -> DataFrame:
    return pages.where(F.length(html_text(F.col("html"))) >= least).select(F.col("page_id").alias("target"))


def rendered(texts: DataFrame, numbers: DataFrame) -> DataFrame:
    """doc_id, text with every {{anchor}} that ``numbers`` (doc_id, anchor, number) knows as Section and its number."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(PLACEHOLDER), F.lit(1)))
    asked = texts.select("doc_id", F.explode(found).alias("anchor")).join(numbers, ["doc_id", "anchor"])
    known = asked.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("anchor", "number"))).alias("known"))
    put = F.aggregate("known", F.col("text"), lambda t, x: F.replace(t, F.concat(F.lit("{{"), x["anchor"], F.lit("}}")), F.concat(F.lit("Section "), x["number"])))
    return texts.join(known, "doc_id", "left").select("doc_id", F.when(F.col("known").isNull(), F.col("text")).otherwise(put).alias("text"))


def line_places(versions: DataFrame) -> DataFrame:
    """conv_id, turn, line, place: where each line of each version stands first."""
    each = versions.select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("place", "line"))
    return each.groupBy("conv_id", "turn", "line").agg(F.min("place").cast("long").alias("place"))


def renumbered(places: DataFrame) -> DataFrame:
    """conv_id, turn, line, place, previous: where an anchor (line) that stays in the document changes its place."""
    before = F.lag("place").over(Window.partitionBy("conv_id", "line").orderBy("turn"))
    return places.withColumn("previous", before).where("previous is not null and previous <> place").select("conv_id", "turn", "line", "place", "previous")


def clause_places(items: DataFrame) -> DataFrame:
    """Line items as numbered clauses: a part is the document, an order its version, a supplier the anchor."""
    return items.groupBy(F.col("l_partkey").alias("conv_id"), F.col("l_orderkey").alias("turn"), F.col("l_suppkey").cast("string").alias("line")).agg(F.min("l_linenumber").cast("long").alias("place"))


def names_in_texts(docs: DataFrame, names: DataFrame) -> DataFrame:
    """name, n_docs: in how many documents each one-word name (column name) stands as a word, by an equi-join of words.

    A row has each of its words once, so where no doc_id repeats, words are counted as they come
    and a task holds the different words alone. Rows of a repeated doc_id are first brought together.
    """
    own = docs.select("doc_id", F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("words"))
    again = cut(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"))
    n = again.count()
    if n:
        once = F.broadcast(again) if n <= MOST_BROADCAST else again
        met = own.join(once, "doc_id", "left_semi").groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
        own = own.join(once, "doc_id", "left_anti").unionByName(met)
    counts = own.select("doc_id", F.explode("words").alias("name")).groupBy("name").agg(F.count("doc_id").alias("n_docs"))
    return counts.join(names.select(F.lower("name").alias("name")).distinct(), "name").select("name", "n_docs")


def citations(docs: DataFrame, pattern: str = CITATION) -> DataFrame:
    """doc_id, citation, n."""
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("citation")).groupBy("doc_id", "citation").agg(F.count("*").alias("n"))


def section_slugs(docs: DataFrame) -> DataFrame:
    """doc_id, pos, slug of every line that opens a section."""
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(~F.col("line").endswith("."))
    return each.select("doc_id", F.col("pos").cast("long").alias("pos"), slug(F.col("line")).alias("slug"))


def version_names(orders: DataFrame) -> DataFrame:
    """o_orderkey, base: the file name under which all of a document's hand-numbered versions meet."""
    name = F.concat(F.lit("Contract"), F.col("o_custkey").cast("string"), F.lit("_v"), (F.col("o_orderkey") % 9).cast("string"), F.when(F.col("o_orderstatus") == "F", "_final_FINAL_revised").otherwise("_draft"), F.lit(".docx"))
    return orders.select("o_orderkey", base_name(name).alias("base"))


def fork_edges(forks: DataFrame) -> DataFrame:
    """item_id, n, doc_id, parent: a template's forks by number; the first is made from the template (parent null), each other from the one of half its number."""
    n = F.row_number().over(Window.partitionBy("item_id").orderBy("doc_id"))
    placed = forks.distinct().withColumn("n", n)
    up = placed.select("item_id", (F.col("n")).alias("half"), F.col("doc_id").alias("parent"))
    return placed.withColumn("half", F.expr("n div 2")).join(up, ["item_id", "half"], "left").select("item_id", "n", "doc_id", "parent")


def fork_lineage(forks: DataFrame) -> DataFrame:
    """item_id, doc_id, depth: forks of forks, level by level."""
    edges = cut(fork_edges(forks))
    level, out, depth = edges.where("parent is null").select("item_id", "doc_id"), None, 1
    while not level.isEmpty():
        level = cut(level)
        now = level.withColumn("depth", F.lit(depth).cast("long"))
        out = now if out is None else out.unionByName(now)
        depth += 1
        level = edges.select("item_id", F.col("doc_id").alias("next"), F.col("parent").alias("doc_id")).join(level, ["item_id", "doc_id"]).select("item_id", F.col("next").alias("doc_id"))
    return out if out is not None else edges.select("item_id", "doc_id", F.lit(0).cast("long").alias("depth"))


def commits_behind(forks: DataFrame, orders: DataFrame) -> DataFrame:
    """item_id, doc_id, behind: versions that the template has seen since the fork was made.

    A template's versions are the orders of the customer of its number, a fork's time is the
    number of its template's versions up to its place among the forks.
    """
    seen = forks.distinct().withColumn("n", F.row_number().over(Window.partitionBy("item_id").orderBy("doc_id")))
    made = orders.groupBy(F.col("o_custkey").alias("item_id")).agg(F.count("*").alias("versions"))
    return seen.join(made, "item_id", "left").select("item_id", "doc_id", F.greatest(F.coalesce("versions", F.lit(0)) - F.col("n"), F.lit(0)).cast("long").alias("behind"))


def conversion_mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """conv_id, turn, pos of the paragraphs that differ between two conversions (conv_id, turn, text), lost ones included."""
    each = lambda df, n: df.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", n))
    met = each(a, "x").join(each(b, "y"), ["conv_id", "turn", "pos"], "full_outer")
    return met.where(~F.col("x").eqNullSafe(F.col("y"))).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"))


def note_integrity(before: DataFrame, after: DataFrame) -> DataFrame:
    """conv_id, note, state: notes lost, added or changed between two versions (conv_id, note, body)."""
    met = before.withColumnRenamed("body", "x").join(after.withColumnRenamed("body", "y"), ["conv_id", "note"], "full_outer")
    state = F.when(F.col("y").isNull(), "lost").when(F.col("x").isNull(), "added").when(F.col("x") != F.col("y"), "changed")
    return met.withColumn("state", state).where("state is not null").select("conv_id", "note", "state")


def notes_of(versions: DataFrame, turn: int) -> DataFrame:
    """conv_id, note, body: a note is known by its place; its body is the words that it begins with."""
    each = bound(versions.where(F.col("turn") == turn).select("conv_id", "text"), lines=F.split(F.coalesce("text", F.lit("")), "\n"))
    return each.select("conv_id", F.posexplode("lines").alias("note", "line")).select("conv_id", F.col("note").cast("long").alias("note"), F.substring("line", 1, 40).alias("body"))
