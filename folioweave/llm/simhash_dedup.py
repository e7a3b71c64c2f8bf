"""SimHash near-duplicates by covering locality-sensitive hashing.

Every pair of fingerprints within the radius shares a bucket for certain. Each of the 64 bit
positions gets a random nonzero vector of radius + 1 bits; each nonzero vector v of that
length makes a mask of the positions whose product with v is odd. Up to ``radius`` differing
positions can't span the whole space, so some v is orthogonal to all of them, and under
its mask the pair agrees.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_LOWER, connected_components, cut

BITS = 64
RADIUS = 4
SEED = 42
SHINGLE_WORDS = 4
#: Buckets of more fingerprints than this link through midpoints instead of pairs.
MAX_BUCKET = 256


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text's word shingles, as a signed 64-bit number; 0 without words."""
    words = (text or "").translate(ASCII_LOWER).encode("utf-8", "surrogatepass").split()
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    hashes = b"".join([xxhash.xxh64_digest(b" ".join(words[k : k + shingle_words]), SEED) for k in range(n)])
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 4096):
        ones += np.unpackbits(np.frombuffer(hashes[8 * at : 8 * (at + 4096)], np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


@F.pandas_udf(T.LongType())
def fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(x) for x in text], dtype="int64")


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def covering_masks(radius: int = RADIUS, seed: int = SEED) -> list[int]:
    """2 ** (radius + 1) - 1 masks; any two words within the radius agree under one of them at least."""
    vectors = np.random.default_rng(seed).permutation(np.resize(np.arange(1, 1 << (radius + 1)), BITS))
    return [sum(1 << k for k, m in enumerate(vectors) if bin(int(m) & v).count("1") % 2) for v in range(1, 1 << (radius + 1))]


def _midpoints(fp: Column, table: Column, masks: list[int], radius: int) -> Column:
    """All words within half the radius that differ from fp in free positions of its table's mask alone."""
    flips = []
    for mask in masks:
        free = [k for k in range(BITS) if not mask >> k & 1]
        flips.append([signed(sum(1 << k for k in c)) for r in range(radius // 2 + 1) for c in combinations(free, r)])
    chosen = F.when(table == 0, F.array(*[F.lit(x) for x in flips[0]]))
    for t in range(1, len(masks)):
        chosen = chosen.when(table == t, F.array(*[F.lit(x) for x in flips[t]]))
    return F.transform(chosen, lambda x: fp.bitwiseXOR(x))


def linked(prints: DataFrame, radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links a, b over distinct fingerprints fp, whose components are those of all pairs within the radius.

    Buckets of up to ``max_bucket`` compare their pairs. A larger one isn't compared: each
    fingerprint names the words within half the radius of it, and those that name the same
    word are within the radius of each other, so they link to the smallest of them. That is
    exact for an even radius and costs a bounded number of rows for each fingerprint.
    """
    if radius % 2:
        raise ValueError("midpoints need an even radius")
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(t).cast("byte").alias("t"), F.lit(signed(m)).alias("m")) for t, m in enumerate(masks)])
    keyed = prints.select("fp", F.explode(tables).alias("x")).select("fp", F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"))
    buckets = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(keyed.join(buckets, ["t", "key"]))
    small, large = shared.where(F.col("n") <= max_bucket), shared.where(F.col("n") > max_bucket)
    pairs = small.select("t", "key", F.col("fp").alias("a")).join(small.select("t", "key", F.col("fp").alias("b")), ["t", "key"])
    pairs = pairs.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    if not large.isEmpty():
        named = large.select("fp", F.explode(_midpoints(F.col("fp"), F.col("t"), masks, radius)).alias("middle")).distinct()
        least = named.groupBy("middle").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
        pairs = pairs.unionByName(named.join(least, "middle").where("a < fp").select("a", F.col("fp").alias("b")))
    return pairs.distinct()


def near_duplicate_components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id for every row of documents.

    Fingerprints within ``radius`` bits link; component_id is the smallest doc_id reachable.
    Texts without words have fingerprint zero and link like any other. Repeated rows get a row
    each. A null doc_id takes part, but names a component only as null, if it is alone.
    """
    prints = cut(docs.select("doc_id", fingerprints("text").alias("fp")))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = connected_components(linked(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    grouped = cut(distinct.join(found, "fp", "left"))
    heads = grouped.where("component is not null").groupBy("component").agg(F.min("first_id").alias("head"))
    named = grouped.join(heads, "component", "left").select("fp", F.when(F.col("component").isNull(), F.col("first_id")).otherwise(F.col("head")).alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents without all but the smallest doc_id of each component, with their own columns.

    Rows without a doc_id can't be told apart and stay. Of repeated rows with the kept
    doc_id each stays. Only ids to drop meet the texts, in an anti join.
    """
    gone = near_duplicate_components(docs, radius).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
