"""Sections, templates, redaction and references of documents and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import EMAIL, IP, bound, html_text, masked, matches

ANCHOR_WORDS = 5


def section_numbers(docs: DataFrame) -> DataFrame:
    """doc_id, pos, number of every line: a line that ends without a full stop opens a section."""
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    each = each.withColumn("heading", (~F.col("line").endswith(".")).cast("int")).withColumn("section", F.sum("heading").over(w))
    inner = F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("pos")) - 1
    return each.select("doc_id", F.col("pos").cast("long").alias("pos"), F.concat_ws(".", F.col("section").cast("string"), inner.cast("string")).alias("number"))


def deep_numbers(lines: DataFrame, key: str, levels: int = 9) -> DataFrame:
    """key, pos, level, number of the headings of ``lines`` (key, pos, level; null for what is no heading): 1.2.3 and so on, to any depth.

    A heading's counter goes up by one, and back to none below a heading of a higher level; a
    level that was left out counts 0. Each counter is the headings of its level so far less
    those up to the last higher one, so all of them come from one sort.
    """
    w = Window.partitionBy(key).orderBy("pos")
    level = F.col("level")
    so_far = lines.withColumns({f"n{k}": F.sum((level == k).cast("int")).over(w) for k in range(1, levels + 1)})
    before = so_far.withColumns({f"r{k}": F.last(F.when(level < k, F.coalesce(f"n{k}", F.lit(0))), ignorenulls=True).over(w) for k in range(1, levels + 1)})
    count = lambda k: (F.coalesce(f"n{k}", F.lit(0)) - F.coalesce(f"r{k}", F.lit(0))).cast("string")
    number = F.concat_ws(".", *[F.when(level >= k, count(k)) for k in range(1, levels + 1)])
    return before.where(level.isNotNull()).select(key, F.col("pos").cast("long").alias("pos"), "level", number.alias("number"))


def leveled(docs: DataFrame) -> DataFrame:
    """doc_id, pos, level of every line: one without a full stop is a heading, of a level from 1 to 5 by its length."""
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return each.select("doc_id", "pos", F.when(~F.col("line").endswith("."), 1 + F.length("line") % 5).alias("level"))


def _windows(words: Column, n: int) -> Column:
    """Hashes of all runs of n words."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))


def template_forks(templates: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, doc_id where a document holds a template's whole text.

    Only a template's first and last word may be parts of a document's words. So its second
    to second last, ANCHOR_WORDS of them at most, stand as a run of words in every document
    that holds it: documents and templates meet by hashes of such runs, and the text decides.
    Templates of one or two words have none and are sought in every text.
    """
    t = bound(templates.where("length(text) > 0").select("item_id", F.col("text").alias("passage")), words=F.split("passage", r"\s+"))
    run = F.least(F.size("words") - 2, F.lit(ANCHOR_WORDS))
    anchors = t.where(F.size("words") >= 3).select("item_id", "passage", run.alias("n"), F.get(_anchor(F.col("words"), run), F.lit(0)).alias("key"))
    tiny = t.where(F.size("words") < 3).select("item_id", "passage")
    lengths = sorted(r["n"] for r in anchors.select("n").distinct().collect())  # ANCHOR_WORDS of them at most
    found = tiny.join(docs.select("doc_id", "text"), F.contains("text", "passage")).select("item_id", "doc_id")
    if not lengths:
        return found
    words = bound(docs.select("doc_id", F.col("text").alias("whole")), words=F.split("whole", r"\s+")).drop("whole")
    keys = words.select("doc_id", F.explode(F.array_distinct(F.concat(*[_windows(F.col("words"), n) for n in lengths]))).alias("key"))
    pairs = keys.join(_small(anchors), "key").select("item_id", "doc_id", "passage").distinct()
    long_ = pairs.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "passage"))
    return long_.select("item_id", "doc_id").unionByName(found)


def _anchor(words: Column, run: Column) -> Column:
    """The hash of the run of words that starts at the second, as an array of one."""
    out = F.array().cast("array<bigint>")
    for n in range(1, ANCHOR_WORDS + 1):
        out = F.when(run == n, F.array(F.xxhash64(*[F.get(words, F.lit(k + 1)) for k in range(n)]))).otherwise(out)
    return out


def _small(df: DataFrame, most: int = 20_000) -> DataFrame:
    """Hints a broadcast if there are ``most`` rows at most; otherwise the join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def gallery(forks: DataFrame, k: int = 10) -> DataFrame:
    return forks.groupBy("item_id").agg(F.count("*").alias("n_forks")).orderBy(F.desc("n_forks"), "item_id").limit(k)


def redaction_hits(docs: DataFrame) -> DataFrame:
    t = F.col("text")
    return docs.select("doc_id", matches(t, EMAIL).alias("n_email"), matches(t, IP).alias("n_ip"))


def redaction_masked(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.md5(masked(F.col("text"))).alias("md5_masked"))


def redaction_pending(docs: DataFrame, reviewed: DataFrame) -> DataFrame:
    return redaction_hits(docs).where("n_email > 0 or n_ip > 0").select("doc_id").join(reviewed, "doc_id", "left_anti")


def page_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.length(html_text(F.col("html"))).cast("long").alias("n_chars"))


def reference_edges(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


def reference_degrees(edges: DataFrame, k: int = 20) -> DataFrame:
    return edges.groupBy("href").agg(F.count_distinct("page_id").alias("n_pages")).orderBy(F.desc("n_pages"), "href").limit(k)


def dangling(edges: DataFrame, pages: DataFrame) -> DataFrame:
    return edges.join(pages.select(F.col("url").alias("href")).distinct(), "href", "left_anti").select("page_id", "href").distinct()


def impact(edges: DataFrame) -> DataFrame:
    return edges.groupBy("href").agg(F.count_distinct("page_id").alias("n_affected"))
