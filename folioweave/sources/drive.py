"""Files of a drive folder, documents in the Docs JSON form, and commits from a git log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The parts of a Docs document that are read.
DOCUMENT = """documentId string, title string, modifiedTime string, lastModifyingUser string,
body struct<content: array<struct<paragraph: struct<paragraphStyle: struct<namedStyleType: string>, elements: array<struct<textRun: struct<content: string, textStyle: struct<bold: boolean, italic: boolean>, suggestedInsertionIds: array<string>>>>>>>>,
comments array<struct<author: string, content: string>>"""
#: ``git log --numstat --format`` that commits() reads: a record separator, then fields between unit separators.
LOG_FORMAT = "%x1e%H%x1f%P%x1f%an%x1f%aI%x1f%s"


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, modified, bytes of every file under a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def originals(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """path, content of the files whose path is wanted."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.join(wanted.select("path"), "path", "left_semi").select("path", "content")


def shadow_texts(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """path, text of all text files of a folder and the folders in it."""
    texts = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True, recursiveFileLookup=True)
    return texts.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents in the Docs JSON form, a file each."""
    return spark.read.schema(DOCUMENT).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)


def markdown(body: Column) -> Column:
    """Headings get their number of #, bold runs ** and italic ones *; paragraphs stand a line apart."""

    def run(e: Column) -> Column:
        text, style = F.coalesce(e["textRun"]["content"], F.lit("")), e["textRun"]["textStyle"]
        mark = F.concat(F.when(style["bold"], "**").otherwise(""), F.when(style["italic"], "*").otherwise(""))
        return F.concat(mark, text, F.reverse(mark))

    def paragraph(c: Column) -> Column:
        level = F.regexp_extract(c["paragraph"]["paragraphStyle"]["namedStyleType"], "^HEADING_([1-6])$", 1)
        head = F.when(level != "", F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "))).otherwise("")
        return F.concat(head, F.array_join(F.transform(c["paragraph"]["elements"], run), ""))

    return F.array_join(F.transform(body["content"], paragraph), "\n\n")


def extracted(docs: DataFrame) -> DataFrame:
    """documentId, title, body, comments, suggestions, formatting; and the two fields of the last change."""
    runs = F.flatten(F.transform("body.content", lambda c: F.transform(c["paragraph"]["elements"], lambda e: e["textRun"])))
    suggested = F.transform(F.filter(runs, lambda r: F.size(r["suggestedInsertionIds"]) > 0), lambda r: r["content"])
    styles = F.transform("body.content", lambda c: F.coalesce(c["paragraph"]["paragraphStyle"]["namedStyleType"], F.lit("NORMAL_TEXT")))
    return docs.select("documentId", "title", markdown(F.col("body")).alias("body"), "comments", suggested.alias("suggestions"), styles.alias("formatting"), "modifiedTime", "lastModifyingUser")


def git_content(found: DataFrame) -> DataFrame:
    """documentId, content and metadata: what is tracked of a document. Suggestions are kept, too, so that none is lost."""
    meta = F.struct("title", F.col("modifiedTime").alias("lastModified"), F.col("lastModifyingUser").alias("author"), "comments", "suggestions", "formatting")
    return found.select("documentId", F.col("body").alias("content"), meta.alias("metadata"))


def conversations_as_documents(turns: DataFrame) -> DataFrame:
    """Conversations in the Docs form: a turn is a paragraph, the first a heading; questions are comments, too."""
    run = F.struct(F.struct(F.col("text").alias("content"), F.struct((F.col("role") == "system").alias("bold"), F.lit(False).alias("italic")).alias("textStyle"), F.array().cast("array<string>").alias("suggestedInsertionIds")).alias("textRun"))
    style = F.struct(F.when(F.col("turn") == 0, "HEADING_1").otherwise("NORMAL_TEXT").alias("namedStyleType"))
    part = F.struct("turn", F.struct(F.struct(style.alias("paragraphStyle"), F.array(run).alias("elements")).alias("paragraph")).alias("p"))
    note = F.when(F.col("role") == "user", F.struct("turn", F.struct(F.col("role").alias("author"), F.substring("text", 1, 20).alias("content")).alias("c")))
    g = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.sort_array(F.collect_list(note)).alias("notes"), F.max_by("role", "turn").alias("lastModifyingUser"))
    return g.select(
        F.col("conv_id").cast("string").alias("documentId"), F.concat(F.lit("Matter "), F.col("conv_id").cast("string")).alias("title"), F.lit(None).cast("string").alias("modifiedTime"), "lastModifyingUser",
        F.struct(F.transform("parts", lambda x: x["p"]).alias("content")).alias("body"), F.transform("notes", lambda x: x["c"]).alias("comments"),
    )


def commits(spark: SparkSession, path: str) -> DataFrame:
    """hash, parents, author, timestamp, message, files of a log written in LOG_FORMAT."""
    rows = spark.read.option("lineSep", "\x1e").text(path).where("trim(value) <> ''")
    lines = F.split("value", "\n")
    field = lambda k: F.get(F.split(F.get(lines, F.lit(0)), "\x1f"), F.lit(k))
    stats = F.filter(lines, lambda x: x.rlike("^[0-9-]+\t[0-9-]+\t"))
    part = lambda x, k: F.get(F.split(x, "\t"), F.lit(k))
    one = lambda x: F.struct(part(x, 2).alias("path"), F.coalesce(F.try_to_number(part(x, 0), F.lit("999999999")).cast("int"), F.lit(0)).alias("additions"), F.coalesce(F.try_to_number(part(x, 1), F.lit("999999999")).cast("int"), F.lit(0)).alias("deletions"))
    parents = F.filter(F.split(field(1), " "), lambda p: p != "")
    return rows.select(field(0).alias("hash"), parents.alias("parents"), field(2).alias("author"), F.to_timestamp(field(3)).alias("timestamp"), field(4).alias("message"), F.transform(stats, one).alias("files"))
