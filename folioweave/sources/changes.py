"""A drive's feed of changes as a data source: read whole, or followed from change to change."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window

from .drive import DOCUMENT

#: A feed is a folder of pages, named by their change token: 00000012.json holds a list of documents in the Docs JSON form, as they were at that change.
CHANGES = "token long, document string"
PER_PARTITION = 100


@dataclass
class Pages(InputPartition):
    names: tuple[str, ...]


class _Feed:
    def __init__(self, path: str) -> None:
        self.path = path

    def pages(self, after: int = 0, until: int | None = None) -> list[Pages]:
        """Groups of the pages whose token is over ``after`` and up to ``until``."""
        names = sorted(x for x in os.listdir(self.path) if x.endswith(".json") and x[:-5].isdigit())
        names = [x for x in names if after < int(x[:-5]) and (until is None or int(x[:-5]) <= until)]
        return [Pages(tuple(names[k : k + PER_PARTITION])) for k in range(0, len(names), PER_PARTITION)]

    def rows(self, partition: Pages) -> Iterator[tuple[int, str]]:
        for name in partition.names:
            with open(os.path.join(self.path, name), encoding="utf-8") as f:
                for document in json.load(f):
                    yield int(name[:-5]), json.dumps(document)


class BatchReader(_Feed, DataSourceReader):
    def partitions(self) -> list[Pages]:
        return self.pages()

    def read(self, partition: Pages) -> Iterator[tuple[int, str]]:
        return self.rows(partition)


class StreamReader(_Feed, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"token": 0}

    def latestOffset(self) -> dict:
        return {"token": max((int(p.names[-1][:-5]) for p in self.pages()), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return self.pages(start["token"], end["token"])

    def read(self, partition: Pages) -> Iterator[tuple[int, str]]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class DriveChanges(DataSource):
    """``format("drive_changes")`` with ``load(path)``, for batches and streams; the folder must be seen by driver and executors."""

    @classmethod
    def name(cls) -> str:
        return "drive_changes"

    def schema(self) -> str:
        return CHANGES

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options["path"])

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options["path"])


def changes(spark: SparkSession, path: str, follow: bool = False) -> DataFrame:
    """token and the fields of each changed document. With ``follow`` a stream, whose checkpoint holds the last token, so a restart goes on there."""
    spark.dataSource.register(DriveChanges)
    read = (spark.readStream if follow else spark.read).format("drive_changes").load(path)
    return read.select("token", F.from_json("document", DOCUMENT).alias("d")).select("token", "d.*")


def latest(found: DataFrame) -> DataFrame:
    """Each document as its last change left it."""
    newest = Window.partitionBy("documentId").orderBy(F.desc("token"))
    return found.withColumn("nth", F.row_number().over(newest)).where("nth = 1").drop("nth")
