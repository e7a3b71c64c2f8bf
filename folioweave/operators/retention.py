"""A history of files under a manifest: deletion rewrites the files it touches and no other, and readers switch at once."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

FILE = "_metadata.file_path"


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    """version, file of every manifest; null before the first."""
    try:
        return spark.read.schema("file string, version long").parquet(f"{path}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def version(spark: SparkSession, path: str) -> int:
    """The number of the manifest in force, 0 before the first."""
    found = _versions(spark, path)
    return 0 if found is None else found.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def files(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """file of the manifest in force, or of an earlier one. A manifest without files holds an empty name."""
    n = version(spark, path) if at is None else at
    return _versions(spark, path).where((F.col("version") == n) & (F.col("file") != "")).select("file")


def _switch(spark: SparkSession, path: str, listed: DataFrame, after: int) -> None:
    """Puts a new manifest in force. It is one file, moved into place when it is whole, so a reader finds the old one or the new one."""
    rows = listed.select("file").unionByName(spark.createDataFrame([("",)], "file string")).distinct()
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest/version={after + 1}")


def append(df: DataFrame, path: str, by: Column | str) -> None:
    """Adds rows to the history, those of one ``by`` together; the first call makes it."""
    spark, own = df.sparkSession, f"{path}/data/{uuid.uuid4().hex}"
    df.repartitionByRange(by).sortWithinPartitions(by).write.parquet(own)
    before = version(spark, path)
    new = spark.read.schema(df.schema).parquet(own).select(F.col(FILE).alias("file")).distinct()
    _switch(spark, path, new if not before else files(spark, path).unionByName(new), before)


def current(spark: SparkSession, path: str, schema: str, at: int | None = None) -> DataFrame:
    """The history's rows. A version's files are never changed, so what a reader has begun it can end."""
    names = [r["file"] for r in files(spark, path, at).collect()]  # names alone, as a reader of files needs them
    read = spark.read.schema(schema)
    return read.parquet(*names) if names else spark.createDataFrame([], schema)


def delete(spark: SparkSession, path: str, schema: str, gone: DataFrame, on: str) -> tuple[int, int]:
    """Takes the rows whose ``on`` is in ``gone`` out of the history: how many files were rewritten, and how many kept.

    Files without such rows stay as they are. The others are written anew without them, then the
    manifest is switched; old files remain for readers of the old version until they are cleaned up.
    """
    before, ids = version(spark, path), gone.select(F.col(on).alias("gone_id")).where("gone_id is not null").distinct()
    rows, listed = current(spark, path, schema), files(spark, path)
    touched = cut(rows.select(F.col(FILE).alias("file"), F.col(on).alias("gone_id")).distinct().join(ids, "gone_id", "left_semi").select("file").distinct()) if before and not listed.isEmpty() else None
    names = [] if touched is None else [r["file"] for r in touched.collect()]
    if not names:
        return 0, listed.count() if before else 0
    own = f"{path}/data/{uuid.uuid4().hex}"
    spark.read.schema(schema).parquet(*names).join(ids, F.col(on) == F.col("gone_id"), "left_anti").write.parquet(own)
    kept = listed.join(touched, "file", "left_anti")
    new = spark.read.schema(schema).parquet(own).select(F.col(FILE).alias("file")).distinct()
    n = kept.count()
    _switch(spark, path, kept.unionByName(new), before)
    return len(names), n
