"""The message rules as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import COMMIT_TYPES, MESSAGE_LIMIT

FUNCTIONS = {
    "message_type(message STRING) RETURNS STRING": r"regexp_extract(message, '^([a-z]+): \\S', 1)",
    "message_is_valid(message STRING) RETURNS BOOLEAN": rf"coalesce(regexp_extract(message, '^([a-z]+): \\S', 1) IN ({', '.join(map(repr, COMMIT_TYPES))}) AND length(message) < {MESSAGE_LIMIT}, false)",
    "heading_slug(heading STRING) RETURNS STRING": "regexp_replace(regexp_replace(lower(heading), '[^a-z0-9]+', '-'), '^-|-$', '')",
}


def register(spark: SparkSession) -> None:
    """Makes message_type, message_is_valid and heading_slug known to SQL; they are inlined, so no Python runs."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
