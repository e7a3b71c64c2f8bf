"""The corpus pipeline: each stage takes what its predecessor kept and hands on the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioweave.llm import line_dedup, mixing, packing, quality_rules, simhash_dedup
from folioweave.llm.common import stored

#: The mixture reads every document once, and those of the rarest source at most so often.
MAX_REPEATS = 1.5
#: Bytes of a batch that Spark hands to Python: 10,000 rows at once, as it would, are 50 MB of texts for each task, on both sides.
BATCH_BYTES = 4 << 20


def batched(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    batched(spark)
    return quality_rules.quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    batched(spark)
    return line_dedup.drop_copied_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    batched(spark)
    return simhash_dedup.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, max_repeats=MAX_REPEATS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    batched(spark)
    return packing.packed_sequences(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", pack),
]

#: Weak supervision, fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for _, stage in first:
        docs = stored(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)
