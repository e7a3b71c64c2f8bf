"""Exact top-k by inner product over a vector-approximation file.

The file keeps one byte for each component: the number of an equally wide cell of its
dimension. A scan of the cells bounds every score from both sides; exact vectors are then
read in order of their upper bounds until no unread one can reach the kth best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut

SCALE = 1024
WAVE = 16
CELLS = 256
#: Rows of a block of the file, and of a block of queries, of which a task holds one each; and queries whose bounds it holds at once.
BLOCK, QUERY_BLOCK, AT_ONCE = 16_384, 4096, 64


def scaled(v: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, or null if the vector is null or has a null or non-finite one. What no long can hold is an error."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    floor = lambda x: F.floor(x.cast("double") * scale)
    whole = F.transform(v, lambda x: F.when(F.abs(x.cast("double") * scale) < F.lit(2.0**63), floor(x)).otherwise(F.raise_error(F.lit(f"a component times {scale} exceeds a long")).cast("long")))
    return F.when(finite, whole)


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct vec_id and v of the rows that take part."""
    return vectors.select("vec_id", scaled(F.col("embedding")).alias("v")).where("vec_id is not null and v is not null").distinct()


def marks(classes: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors, each dimension's least value and cell width; a row for each dimension reaches the driver."""
    spans = classes.select(F.size("v").alias("d"), F.posexplode("v").alias("at", "x")).groupBy("d", "at").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    found: dict[int, list] = {}
    for r in spans.orderBy("d", "at").collect():
        found.setdefault(r["d"], []).append((r["lo"], (r["hi"] - r["lo"]) // CELLS + 1))
    return {d: tuple(np.array(x, np.int64).T) for d, x in found.items()}


def approximation_file(classes: DataFrame, spans: dict[int, tuple[np.ndarray, np.ndarray]], blocks: int) -> DataFrame:
    """class_id, d, block and cells of every vector, a byte for each component."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, cells = batch["d"].to_numpy(), [b""] * batch.num_rows
            for d in np.unique(sizes[sizes > 0]):
                at, (lo, width) = np.flatnonzero(sizes == d), spans[int(d)]
                v = batch["v"].take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
                for k, row in zip(at, ((v - lo) // width).astype(np.uint8), strict=True):
                    cells[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch["class_id"], batch["d"], batch["block"], pa.array(cells, pa.binary())], ["class_id", "d", "block", "cells"])

    rows = classes.select("class_id", F.size("v").alias("d"), F.pmod(F.xxhash64("class_id"), F.lit(blocks)).alias("block"), "v")
    return rows.mapInArrow(encode, "class_id long, d int, block long, cells binary")


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def bounds(spans: dict[int, tuple[np.ndarray, np.ndarray]], most: int):
    """Scans a block of cells for a block of queries; keeps what neither the block nor a query's ``floor`` rules out of the best ``most``.

    Bounds are in floating point and widened by more than its error, so large values only loosen them.
    """
    names = ["ask_id", "class_id", "low", "high"]

    def scan(key: tuple[pa.Scalar, ...], file: pa.Table, queries: pa.Table) -> pa.Table:
        d, found = key[0].as_py(), []
        if not file.num_rows or not queries.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
        if d:
            lo, width = (x.astype(np.float64) for x in spans[d])
            least = lo + np.frombuffer(b"".join(file["cells"].to_pylist()), np.uint8).reshape(-1, d) * width
            greatest, questions = least + (width - 1), _matrix(queries["v"], d)
            reach = np.maximum(np.abs(least), np.abs(greatest))
        known = np.array([-np.inf if x is None else x for x in queries["floor"].to_pylist()])
        for k in range(0, queries.num_rows, AT_ONCE):
            if d:
                q = questions[k : k + AT_ONCE]
                up, down = np.maximum(q, 0), np.minimum(q, 0)
                high, low = up @ greatest.T + down @ least.T, up @ least.T + down @ greatest.T
                slack = (np.abs(q) @ reach.T) * ((d + 16) * 2.0**-51)
                high, low = high + slack, low - slack
            else:
                high = low = np.zeros((min(AT_ONCE, queries.num_rows - k), file.num_rows))
            n, floor = low.shape[1], known[k : k + AT_ONCE]
            if n > most:
                floor = np.maximum(floor, np.partition(low, n - most, axis=1)[:, n - most])
            at, c = np.nonzero(high >= floor[:, None])
            found.append((at + k, c, low[at, c], high[at, c]))
        at, c, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table([queries["ask_id"].take(pa.array(at)), file["class_id"].take(pa.array(c)), pa.array(low), pa.array(high)], names=names)

    return scan


def waves(blocks: int) -> Iterator[tuple[int, int]]:
    """Ranges of blocks, each WAVE times as many as all before it: what those found are its floors."""
    begun, size = 0, 1
    while begun < blocks:
        yield begun, min(begun + size, blocks)
        begun, size = begun + size, (begun + size) * WAVE


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def top_k(vectors: DataFrame, k: int = 10, query_every: int = 100, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k greatest integer inner products, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``query_every``; candidates are all rows
    but those with the query's vec_id. Only vectors of the query's length are compared. Null
    ids and unusable vectors take no part, and repeated rows count once; a vec_id with several
    vectors stands with each. An empty table gives no rows. A score that no long can hold is an error.

    Equal vectors form one class, searched once. Only its k + 1 smallest ids can be in any
    answer, one of them perhaps the query's own, and k + 1 classes hold k other ids. The scan
    is a grid of fixed blocks of the file by fixed blocks of queries, so a task's memory
    doesn't grow with either. It goes in waves of ever more blocks; each starts from the kth lower
    bounds of those before, so what the blocks give grows with the queries. Exact vectors are then read in the order of their bounds, each
    round twice as many as before, until no bound left reaches the best that were read.
    """
    rows = cut(usable(vectors))
    order = Window.partitionBy("v").orderBy("vec_id")
    members = cut(rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1))
    classes = cut(members.where("nth = 1").select(F.monotonically_increasing_id().alias("class_id"), "v"))
    members = members.join(classes, "v").select("class_id", "vec_id")
    queries = cut(rows.where(F.col("vec_id") % query_every == 0).select(F.monotonically_increasing_id().alias("ask_id"), F.col("vec_id").alias("query_id"), "v"))
    n, asked = classes.count(), queries.count()
    schema = T.StructType([T.StructField(x, t) for x, t in (("ask_id", T.LongType()), ("class_id", T.LongType()), ("low", T.DoubleType()), ("high", T.DoubleType()))])
    spans, blocks, groups, most = marks(classes), max(1, -(-n // block)), max(1, -(-asked // query_block)), k + 1

    best = lambda c: Window.partitionBy("ask_id").orderBy(F.desc(c))
    file, asks, keys, scanned = cut(approximation_file(classes, spans, blocks)), queries.select("ask_id", "v", F.size("v").alias("d"), F.pmod(F.xxhash64("ask_id"), F.lit(groups)).cast("int").alias("group")), ["d", "block", "group"], None
    floor = asks.select("ask_id", F.lit(None).cast("double").alias("floor"))
    for begun, ended in waves(blocks):
        here = file.where(F.col("block").between(begun, ended - 1)).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        there = asks.join(floor, "ask_id", "left").withColumn("block", F.explode(F.sequence(F.lit(begun).cast("long"), F.lit(ended - 1).cast("long"))))
        found = cut(here.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(bounds(spans, most), schema))
        scanned = found if scanned is None else scanned.unionByName(found)
        kth = scanned.withColumn("nth", F.row_number().over(best("low"))).where(F.col("nth") <= most).groupBy("ask_id").agg(F.min("low").alias("floor"), F.count("*").alias("n"))
        floor = cut(kth.select("ask_id", F.when(F.col("n") == most, F.col("floor")).alias("floor")))
    left = cut(scanned.join(floor, "ask_id").where("floor is null or high >= floor").select("ask_id", "class_id", "high"))

    read, turn = None, most
    while not left.isEmpty():
        batch = left.withColumn("nth", F.row_number().over(best("high"))).where(F.col("nth") <= turn).drop("nth")
        exact = batch.join(classes, "class_id").join(queries.select("ask_id", "query_id", F.col("v").alias("q")), "ask_id")
        found = exact.where(F.size("q") == F.size("v")).select("ask_id", "query_id", "class_id", dot(F.col("q"), F.col("v")).alias("score"))
        read = cut(found if read is None else read.unionByName(found))
        certain = read.withColumn("nth", F.row_number().over(best("score"))).where(F.col("nth") <= most).groupBy("ask_id").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
        left = left.join(read.select("ask_id", "class_id"), ["ask_id", "class_id"], "left_anti").join(certain, "ask_id")
        left = cut(left.where((F.col("n") < most) | (F.col("high") >= F.col("kth").cast("double"))).select("ask_id", "class_id", "high"))
        turn *= 2
    if read is None:
        return queries.select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0).cast("long").alias("score")).where("false")
    scores = read.join(members, "class_id").where("vec_id <> query_id").select("query_id", "vec_id", "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH usable AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
