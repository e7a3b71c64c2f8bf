"""Column functions over messages, references and confidential text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The closed vocabulary of commit types.
COMMIT_TYPES = ("feat", "fix", "review", "draft", "final", "docs", "redact", "merge", "revert", "comment", "cite", "format")
#: A message is shorter than this.
MESSAGE_LIMIT = 50
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"
IP = r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
URI = r"firm://[A-Za-z0-9._/-]+"


def message_type(message: Column) -> Column:
    """The type before the colon, empty if the message isn't of the form ``type: description``."""
    return F.regexp_extract(message, r"^([a-z]+): \S", 1)


def message_is_valid(message: Column) -> Column:
    return F.coalesce(message_type(message).isin(*COMMIT_TYPES) & (F.length(message) < MESSAGE_LIMIT), F.lit(False))


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("long")


def masked(text: Column) -> Column:
    for pattern, mask in ((EMAIL, "[EMAIL]"), (IP, "[IP]"), (SSN, "[SSN]")):
        text = F.regexp_replace(text, pattern, mask)
    return text


def references(text: Column) -> Column:
    """Array of the reference URIs in a text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(URI), F.lit(0))


def reference_parts(uri: Column) -> Column:
    parts = F.split(F.regexp_replace(uri, "^firm://", ""), "/")
    return F.struct(F.element_at(parts, 1).alias("authority"), F.slice(parts, 2, F.size(parts)).alias("segments"))


def slug(heading: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(heading), "[^a-z0-9]+", "-"), "^-|-$", "")


def base_name(name: Column) -> Column:
    """A file name without the marks people add for versions: _v3, _final, _revised, copies of them."""
    return F.regexp_replace(F.lower(name), r"([_ -]*(v[0-9]+|final|revised|draft|copy))+(?=$|[.])", "")


def html_text(html: Column) -> Column:
    """Text of a page: scripts and tags go, white space collapses."""
    bare = F.regexp_replace(F.regexp_replace(html, "<(script|style)[^>]*>[^<]*</(script|style)>", " "), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, "[ \t\r\n]+", " "))


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    return F.unix_date(ts.cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts)).cast("long")


def bound(df: DataFrame, **made: Column) -> DataFrame:
    """df with new columns that are computed once for each row.

    Spark may repeat an expression at each use, in a lambda even for each element; a generator of one row stops that.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))
