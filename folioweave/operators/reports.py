"""Ratios of use and business, signature packages, warnings and interchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import EMAIL, matches
from ..session import new_folder
from .quantiles import exact_quantiles
from .records import ISO, commit_hash

#: What users are warned of, by situation.
WARNINGS = {
    "template": "Remove all client-specific information",
    "sensitive": "This change will be permanently recorded",
    "public": "This repo is visible to all firm members",
    "cross_matter": "Linking to confidential client matter",
}
BRANCH = "^[a-z0-9]+(-[a-z0-9]+)*$"
TAG = "^client-([0-9a-z]+)-final-v([0-9]+)[.]([0-9]+)$"


def ratio(part: Column, whole: Column) -> Column:
    return F.round(F.when(whole > 0, part / whole), 6)


def distinct_where(c: str, condition: Column) -> Column:
    return F.count_distinct(F.when(condition, F.col(c)))


def monthly_active(events: DataFrame) -> DataFrame:
    """month, active, share of all users that ever acted."""
    every = events.agg(F.count_distinct("user_id").alias("installed"))
    each = events.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count_distinct("user_id").alias("active"))
    return each.crossJoin(F.broadcast(every)).select("month", "active", ratio(F.col("active"), F.col("installed")).alias("share"))  # one row


def adoption(events: DataFrame) -> DataFrame:
    """Shares of users that use the advanced feature, finish a task, raise a ticket; and contributors from outside."""
    kind, users = F.col("event_type"), F.count_distinct("user_id")
    return events.agg(
        ratio(distinct_where("user_id", kind == "purchase"), users).alias("advanced"),
        ratio(distinct_where("user_id", kind == "view"), users).alias("tutorial"),
        ratio(distinct_where("user_id", (kind == "error") & (F.col("value") > 100)), users).alias("tickets"),
        distinct_where("user_id", (kind == "signup") & (F.col("value") > 200)).alias("contributors"),
    )


def promoter_score(events: DataFrame) -> DataFrame:
    """The net share of promoters (9 and 10) over detractors (0 to 6), in hundredths, of scores from 0 to 10."""
    score = F.least(F.floor(F.col("value") / 10), F.lit(10))
    return events.where("value is not null").agg(F.round(F.avg(F.when(score >= 9, 1).when(score <= 6, -1).otherwise(0)) * 100, 4).alias("nps"))


def response_times(events: DataFrame) -> DataFrame:
    """event_type, p50, p95, p99 and longest of values, exact: see exact_quantiles()."""
    found = exact_quantiles(events, "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99, "longest": 1.0})
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")], "longest")


def approximate_users(events: DataFrame) -> DataFrame:
    """Users for each type, within a few hundredths: bounded memory however many there are."""
    return events.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


def template_share(docs: DataFrame, forks: DataFrame) -> DataFrame:
    """The share of sources (firms) with a document made from a template."""
    used = docs.join(forks.select("doc_id").distinct(), "doc_id", "left_semi").agg(F.count_distinct("source").alias("used"))
    return docs.agg(F.count_distinct("source").alias("firms")).crossJoin(used).select(ratio(F.col("used"), F.col("firms")).alias("share"))  # one row each


def reference_share(pages: DataFrame, found: DataFrame) -> DataFrame:
    """The share of pages with a reference that resolves."""
    known = found.where("target is not null").select("page_id").distinct().withColumn("seen", F.lit(1))
    return pages.join(known, "page_id", "left").agg(ratio(F.count("seen"), F.count("*")).alias("share"))


def churn(orders: DataFrame) -> DataFrame:
    """year, customers, lost, rate: customers of a year without an order in the next."""
    each = orders.select("o_custkey", F.year("o_orderdate").alias("year")).distinct()
    last = orders.agg(F.max(F.year("o_orderdate")).alias("last"))
    stayed = each.select("o_custkey", (F.col("year") - 1).alias("year"), F.lit(1).alias("stayed"))
    met = each.join(stayed, ["o_custkey", "year"], "left").crossJoin(F.broadcast(last)).where("year < last")  # one row
    lost = F.count("*") - F.count("stayed")
    return met.groupBy("year").agg(F.count("*").alias("customers"), lost.alias("lost"), ratio(lost, F.count("*")).alias("rate"))


def lifetime_value(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Mean spend of those who order, and the share of all customers that do."""
    spent = orders.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("spent"))
    met = customers.join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return met.agg(F.round((F.sum("spent") / F.count("spent")).cast("double"), 2).alias("value"), ratio(F.count("spent"), F.count("*")).alias("penetration"))


def support_share(items: DataFrame) -> DataFrame:
    """The tax on lines as a share of their price: what support costs of revenue."""
    price, tax = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_tax").cast("decimal(4,2)")
    return items.agg(F.round((F.sum(price * tax) / F.sum(price)).cast("double"), 6).alias("share"))


def signature_packages(orders: DataFrame, totals: DataFrame) -> DataFrame:
    """o_orderkey and the package of each signed version as JSON: document, git_commit, git_tag, signature_timestamp, change_summary."""
    tag = F.concat(F.lit("client-"), F.col("o_custkey").cast("string"), F.lit("-final-v"), F.col("n_files").cast("string"), F.lit(".0"))
    text = F.concat(F.lit("Added "), F.col("additions").cast("string"), F.lit(" lines in "), F.col("n_files").cast("string"), F.lit(" files"))
    package = F.struct(
        F.lit("document.pdf").alias("document"), F.substring(commit_hash(F.col("o_orderkey")), 1, 20).alias("git_commit"), tag.alias("git_tag"),
        F.date_format("o_orderdate", ISO).alias("signature_timestamp"), text.alias("change_summary"),
    )
    return orders.where("o_orderstatus = 'F'").join(totals, "o_orderkey").select("o_orderkey", F.to_json(package).alias("package"))


def tag_parts(tag: Column) -> Column:
    part = lambda k: F.regexp_extract(tag, TAG, k)
    return F.struct(part(1).alias("client"), part(2).alias("major"), part(3).alias("minor"))


def branch_is_valid(name: Column) -> Column:
    return F.coalesce(name.rlike(BRANCH), F.lit(False))


def branches(customers: DataFrame) -> DataFrame:
    """c_custkey, branch made from the segment, and whether its name is allowed."""
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Client Review "), F.col("c_mktsegment"))).otherwise(F.concat(F.lower("c_mktsegment"), F.lit("-review-"), F.col("c_custkey").cast("string")))
    return customers.select("c_custkey", name.alias("branch"), branch_is_valid(name).alias("valid"))


def warned(docs: DataFrame, forks: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, warnings joined by |: template text, sensitive content, a public source, links to other sites."""
    template = forks.select("doc_id").distinct().withColumn("is_template", F.lit(True))
    toxic = labels.where("toxic = 1").select("doc_id").distinct().withColumn("is_toxic", F.lit(True))
    met = docs.join(template, "doc_id", "left").join(toxic, "doc_id", "left")
    when = {"template": F.col("is_template"), "sensitive": F.coalesce(F.col("is_toxic"), F.lit(False)) | (matches(F.col("text"), EMAIL) > 0), "public": F.col("source") == "src0", "cross_matter": F.contains("text", F.lit("://"))}
    found = F.array_compact(F.array(*[F.when(when[k], w) for k, w in WARNINGS.items()]))
    return met.select("doc_id", F.array_join(found, "|").alias("warnings"))


def suggested_type(numstat: DataFrame) -> DataFrame:
    """conv_id, turn, type: the commit type that scores highest for a version's added and removed lines, by name on a tie."""
    a, d = F.col("additions"), F.col("deletions")
    scores = {"feat": F.greatest(a - d, F.lit(0)), "redact": F.greatest(d - a, F.lit(0)), "fix": F.least(a, d), "format": F.when(a + d == 0, 1).otherwise(0)}
    best = F.array_max(F.array(*[F.struct(s.cast("long").alias("score"), F.lit(t).alias("type")) for t, s in scores.items()]))
    return numstat.select("conv_id", "turn", best["type"].alias("type"))


def property_values(events: DataFrame) -> DataFrame:
    """event_id, k from the JSON of props; and the JSON built again from it."""
    parsed = F.from_json("props", "k bigint")
    return events.select("event_id", parsed["k"].alias("k"), F.to_json(parsed).alias("rebuilt"))


def json_files(df: DataFrame) -> DataFrame:
    """The frame written as files of JSON lines and read again."""
    path = new_folder(df.sparkSession, "json")
    df.write.json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def xml_files(df: DataFrame) -> DataFrame:
    """The frame written as XML files and read again. White space at the ends of texts is kept; empty texts are read as nulls."""
    path = new_folder(df.sparkSession, "xml")
    df.write.option("rowTag", "row").xml(path)
    return df.sparkSession.read.schema(df.schema).option("rowTag", "row").option("ignoreSurroundingSpaces", "false").xml(path)


def sent_and_read_again(df: DataFrame, through) -> DataFrame:
    """lost and made up rows of an interchange format: both 0 if the round trip keeps every row."""
    again = through(df)
    side = lambda x, n: x.agg(F.count("*").alias("n")).select(F.lit(n).alias("side"), "n")
    return side(df.exceptAll(again), "lost").unionByName(side(again.exceptAll(df), "made_up"))
