"""Word documents by path: paragraphs, comments and tracked changes."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = ("document", "comments")


def word_parts(spark: SparkSession, path: str) -> DataFrame:
    """path, document, comments: the XML of each .docx under a path; files that aren't archives give nulls."""

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                    names = set(z.namelist())
                    rows.append((path, *[z.read(f"word/{p}.xml").decode() if f"word/{p}.xml" in names else None for p in PARTS]))
                except zipfile.BadZipFile:
                    rows.append((path, None, None))
            yield pd.DataFrame(rows, columns=["path", *PARTS])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path)
    return files.select("path", "content").mapInPandas(unzip, "path string, document string, comments string")


def _plain(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _run_text(xml: str) -> Column:
    return _plain(F.array_join(F.regexp_extract_all(xml, F.lit(r"(?s)<w:t(?: [^>]*)?>(.*?)</w:t>"), F.lit(1)), ""))


def paragraphs(parts: DataFrame) -> DataFrame:
    """path, pos, text, style, formatting: each paragraph, whose XML is cut out first so that its runs can be joined.

    Empty paragraphs count. formatting says of bold, italic and underline whether any run has it, and names the alignment.
    """
    p = F.regexp_extract_all("document", F.lit(r"(?s)<w:p(?:\s[^>]*)?/>|<w:p(?:\s[^>]*)?>.*?</w:p>"), F.lit(0))
    style = F.regexp_extract("xml", r'<w:pStyle w:val="([^"]*)"', 1)
    has = lambda tag: F.col("xml").rlike(rf'<w:{tag}(?:\s*/>|>| w:val="(?!0|false|none)[^"]*"\s*/>)').cast("string")
    aligned = F.regexp_extract("xml", r'<w:jc w:val="([^"]*)"', 1)
    formatting = F.create_map(F.lit("bold"), has("b"), F.lit("italic"), has("i"), F.lit("underline"), has("u"), F.lit("alignment"), F.when(aligned == "", "left").otherwise(aligned))
    each = parts.where("document is not null").select("path", F.posexplode(p).alias("pos", "xml"))
    return each.select("path", "pos", _run_text("xml").alias("text"), F.when(style == "", "Normal").otherwise(style).alias("style"), formatting.alias("formatting"))


def comments(parts: DataFrame) -> DataFrame:
    """path, id, author, text of each comment."""
    found = F.regexp_extract_all("comments", F.lit(r"(?s)<w:comment .*?</w:comment>"), F.lit(0))
    xml = parts.where("comments is not null").select("path", F.explode(found).alias("xml"))
    return xml.select("path", F.regexp_extract("xml", 'w:id="([^"]*)"', 1).alias("id"), F.regexp_extract("xml", 'w:author="([^"]*)"', 1).alias("author"), _run_text("xml").alias("text"))


def tracked_changes(parts: DataFrame) -> DataFrame:
    """path, kind (ins or del), author, text."""
    found = F.regexp_extract_all("document", F.lit(r"(?s)<w:(?:ins|del) .*?</w:(?:ins|del)>"), F.lit(0))
    xml = parts.where("document is not null").select("path", F.explode(found).alias("xml"))
    text = F.array_join(F.regexp_extract_all("xml", F.lit(r"(?s)<w:(?:t|delText)(?: [^>]*)?>(.*?)</w:(?:t|delText)>"), F.lit(1)), "")
    return xml.select("path", F.regexp_extract("xml", "^<w:(ins|del)", 1).alias("kind"), F.regexp_extract("xml", 'w:author="([^"]*)"', 1).alias("author"), text.alias("text"))
