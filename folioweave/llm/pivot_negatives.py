"""Hard negatives by exact inner product, found over a table of distances to pivots.

A vector x gets one more component, so that all lie on a sphere of radius M, the greatest
norm; an anchor q is stretched to that radius with a zero there. The inner product is then a
function of their Euclidean distance: q.x = |q| / M * (M^2 - distance^2 / 2). Each vector's
distances to a few pivots are stored. By the triangle inequality they bracket its distance
from an anchor, and so its score; exact products are taken only of what the brackets leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut
from .va_topk import scaled, waves

SCALE = 256
PIVOTS = 16
#: Vectors from which the pivots are chosen, drawn by a hash; the only sample, and every vector is indexed.
SAMPLE = 2048
#: Vectors and anchors that a task compares, and anchors it holds bounds of at once.
BLOCK, ANCHORS, AT_ONCE = 8192, 2048, 64
EXACT_FIRST = 256


def usable(vectors: DataFrame, relabel_every: int | None, labels: int) -> DataFrame:
    """vec_id, label, v of the rows that take part, each once."""
    label = F.col("label").cast("long")
    if relabel_every:
        label = F.when(F.col("vec_id") % relabel_every == 0, (label + 1) % labels).otherwise(label)
    found = vectors.select("vec_id", label.alias("label"), scaled(F.col("embedding"), SCALE).alias("v"))
    return found.where("vec_id is not null and label is not null and v is not null").distinct()


def pivots(classes: DataFrame, count: int, sample: int) -> dict[int, np.ndarray]:
    """For each length of vectors, ``count`` of a sample's vectors that lie far from each other."""
    found: dict[int, list] = {}
    for r in classes.orderBy(F.xxhash64("class_id")).limit(sample).select("v").collect():
        found.setdefault(len(r["v"]), []).append(r["v"])
    out = {}
    for d, rows in found.items():
        x = np.array(rows, np.float64).reshape(len(rows), d)
        chosen, nearest = [0], np.full(len(x), np.inf)
        while len(chosen) < min(count, len(x)):
            nearest = np.minimum(nearest, ((x - x[chosen[-1]]) ** 2).sum(1))
            chosen.append(int(nearest.argmax()))
        out[d] = x[chosen]
    return out


class Sphere:
    """Distances on the sphere of radius ``radius``, with what rounding may add to them."""

    def __init__(self, radius: float, pivots: dict[int, np.ndarray]) -> None:
        self.radius, self.pivots = radius, pivots

    def _more(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.radius**2 - (x * x).sum(1), 0))

    def slack(self, d: int) -> float:
        return 4 * self.radius * ((d + 16) * 2.0**-50) ** 0.5

    def stored(self, x: np.ndarray) -> np.ndarray:
        """Each vector's distance from each pivot."""
        p = self.pivots.get(x.shape[1], np.empty((0, x.shape[1])))
        product = x @ p.T + np.outer(self._more(x), self._more(p))
        return np.sqrt(np.maximum(2 * self.radius**2 - 2 * product, 0))

    def asked(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each anchor's norm, and the distance of its stretched form from each pivot."""
        p, norm = self.pivots.get(q.shape[1], np.empty((0, q.shape[1]))), np.sqrt((q * q).sum(1))
        product = (q @ p.T) * np.divide(self.radius, norm, out=np.zeros_like(norm), where=norm > 0)[:, None]
        return norm, np.sqrt(np.maximum(2 * self.radius**2 - 2 * product, 0))

    def brackets(self, norm: np.ndarray, asked: np.ndarray, stored: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score that each anchor and vector can have."""
        near, far = np.zeros((len(asked), len(stored))), np.full((len(asked), len(stored)), 2 * self.radius)
        for k in range(asked.shape[1]):
            a, b = asked[:, k, None], stored[None, :, k]
            np.maximum(near, np.abs(a - b), out=near)
            np.minimum(far, a + b, out=far)
        slack = self.slack(d)
        near, far = np.maximum(near - slack, 0), far + slack
        stretch, wide = (norm / self.radius)[:, None] if self.radius else norm[:, None], (norm * self.radius * 2.0**-45)[:, None] + 2.0**-20
        return stretch * (self.radius**2 - far**2 / 2) - wide, stretch * (self.radius**2 - near**2 / 2) + wide


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _products(q: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products; in floating point where that holds them all."""
    if most < 2.0**53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if most >= 2.0**63:
        raise OverflowError("a score exceeds a long")
    return x @ q


FOUND = "ask_id long, class_id long, first long, score long"
LEAST, GREATEST = -(1 << 63), (1 << 63) - 1


def scan(sphere: Sphere, k: int, same_label: bool):
    """Compares a block of vectors with a block of anchors: what the block has for the best ``k`` of each anchor's windows.

    An anchor's windows are the ranges of scores from ``lows`` to ``highs``; ``floors`` are
    the kth scores known in them, or null. ``same_label`` says whether vectors of the anchor's label are
    meant, or those of the others.
    """
    names = ["ask_id", "class_id", "first", "score"]

    def compare(key: tuple[pa.Scalar, ...], file: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        if file.num_rows and asked.num_rows:
            d = key[0].as_py()
            x, q = _matrix(file["v"], d), _matrix(asked["v"], d)
            stored = _matrix(file["distances"], len(sphere.pivots.get(d, ())))
            label, first = file["label"].to_numpy(), file["first"].to_numpy()
            most = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0)) * d
            norm, distance = sphere.asked(q.astype(np.float64))
            wanted = asked["label"].to_numpy()
            lows, highs, floors = (asked[c].to_pylist() for c in ("lows", "highs", "floors"))
            for at in range(0, len(q), AT_ONCE):
                low, high = sphere.brackets(norm[at : at + AT_ONCE], distance[at : at + AT_ONCE], stored, d)
                for a in range(len(low)):
                    r = at + a
                    needed = np.array([x if f is None else max(x, f) for x, f in zip(lows[r], floors[r], strict=True)], np.int64)
                    greatest = np.array(highs[r], np.int64)
                    left = ((label == wanted[r]) == same_label) & (high[a] >= needed.min())
                    if greatest.max() < GREATEST:  # else what exceeds a long must be seen, and raise
                        left &= low[a] <= greatest.max()
                    if (got := _survivors(np.flatnonzero(left), high[a], q[r], x, most, needed, greatest, first, k)) is not None:
                        out.append((asked["ask_id"][r].as_py(), *got))
        if not out:
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        rows, score = (np.concatenate(c) for c in list(zip(*out, strict=True))[1:])
        asks = np.repeat(np.array([a for a, _, _ in out], np.int64), [len(c) for _, c, _ in out])
        return pa.table([pa.array(asks), file["class_id"].take(pa.array(rows)), file["first"].take(pa.array(rows)), pa.array(score)], names=names)

    return compare


def _survivors(left: np.ndarray, high: np.ndarray, q: np.ndarray, x: np.ndarray, most: float, needed: np.ndarray, highs: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Exact scores of what is left, highest brackets first, until none reaches a kth best: rows and scores of each window's best."""
    left = left[np.argsort(-high[left], kind="stable")]
    rows, scores, at, step = [], [], 0, EXACT_FIRST
    while at < len(left) and high[left[at]] >= needed.min():
        rows.append(left[at : at + step])
        scores.append(_products(q, x[rows[-1]], most))
        at, step = at + step, step * 2
        score = np.concatenate(scores)
        for w, greatest in enumerate(highs):
            inside = score[score <= greatest]
            if len(inside) >= k:
                needed[w] = max(needed[w], np.partition(inside, len(inside) - k)[len(inside) - k])
    if not rows:
        return None
    row, kept = np.concatenate(rows), set()
    for w, greatest in enumerate(highs):
        fits = np.flatnonzero((score >= needed[w]) & (score <= greatest))
        kept.update(fits[np.lexsort((first[row[fits]], -score[fits]))[:k]].tolist())
    chosen = np.array(sorted(kept), np.int64)
    return row[chosen], score[chosen]


def _with_floors(asks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """asks with the kth score found so far in each window, null where fewer were found."""
    windows = asks.select("ask_id", F.posexplode("highs").alias("w", "greatest"))
    best = Window.partitionBy("ask_id", "w").orderBy(F.desc("score"))
    inside = found.select("ask_id", "score").join(windows, "ask_id").where("score <= greatest").withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k)
    known = inside.groupBy("ask_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("known"))
    floors = F.transform(F.sequence(F.lit(0), F.size("highs") - 1), lambda w: F.element_at("known", w))
    return asks.drop("floors").join(known, "ask_id", "left").withColumn("floors", floors).drop("known")


def hard_negatives(
    vectors: DataFrame, positives: int = 5, negatives: int = 5, least_percent: int = 80, anchor_every: int = 100, relabel_every: int | None = None,
    labels: int = 10, block: int = BLOCK, anchors: int = ANCHORS, pivot_count: int = PIVOTS, sample: int = SAMPLE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``anchor_every``, their positives the
    ``positives`` best other rows of the same label; of each pair the ``negatives`` best rows of
    another label whose score is from ``least_percent`` (0 to 100) percent of the positive's to
    that itself, all ties to the smaller vec_id. With ``relabel_every``, rows whose vec_id it divides
    first move to the next of ``labels`` labels. Null ids or labels and vectors that are null or
    hold a null or non-finite component take no part; repeated rows count once; a vec_id with
    several vectors or labels stands with each, and none of its rows is its own positive. Only
    vectors of one length are compared. Other columns are ignored. An empty table gives no rows.
    A component or score that no long can hold is an error.

    Rows of equal vector and label form a class, searched once; its first ids are all that an
    answer can hold. Blocks of classes meet blocks of anchors in a grid of bounded tasks, in
    waves each of which starts from the kth scores of those before, so what the blocks give
    grows with the anchors, not with anchors times blocks.
    """
    rows = cut(usable(vectors, relabel_every, labels))
    order = Window.partitionBy("label", "v").orderBy("vec_id")
    members = cut(rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max(positives + 1, negatives)))
    classes = cut(members.where("nth = 1").select(F.monotonically_increasing_id().alias("class_id"), "label", "v", F.col("vec_id").alias("first")))
    members = members.join(classes, ["label", "v"]).select("class_id", "vec_id")
    asked = cut(rows.where(F.col("vec_id") % anchor_every == 0).select(F.monotonically_increasing_id().alias("ask_id"), F.col("vec_id").alias("anchor_id"), "label", "v", F.size("v").alias("d")))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, greatest, n_asked = *classes.agg(F.count("*"), F.max(norm)).first(), asked.count()
    sphere = Sphere((greatest or 0.0) ** 0.5 * (1 + 2.0**-30), pivots(classes, pivot_count, sample))
    blocks, groups = max(1, -(-n // block)), max(1, -(-n_asked // anchors))

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far: list[list[float]] = [[]] * batch.num_rows
            sizes = batch["d"].to_numpy()
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                for k, x in zip(at, sphere.stored(_matrix(pa.chunked_array([batch["v"].take(pa.array(at))]), d).astype(np.float64)).tolist(), strict=True):
                    far[k] = x
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far, pa.list_(pa.float64()))], [*batch.schema.names, "distances"])

    numbered = classes.select("class_id", "label", "first", "v", F.size("v").alias("d"), F.pmod(F.xxhash64("class_id"), F.lit(blocks)).alias("block"))
    table = cut(numbered.mapInArrow(distances, "class_id long, label long, first long, v array<bigint>, d int, block long, distances array<double>"))

    def search(asks: DataFrame, k: int, same_label: bool) -> DataFrame:
        keys, found = ["d", "block", "group"], None
        asks = asks.withColumn("floors", F.transform("highs", lambda x: F.lit(None).cast("long")))
        for begun, ended in waves(blocks):
            here = table.where(F.col("block").between(begun, ended - 1)).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
            there = asks.withColumn("group", F.pmod(F.xxhash64("ask_id"), F.lit(groups)).cast("int"))
            there = there.withColumn("block", F.explode(F.sequence(F.lit(begun).cast("long"), F.lit(ended - 1).cast("long"))))
            got = cut(here.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(scan(sphere, k, same_label), FOUND))
            found = got if found is None else found.unionByName(got)
            if ended < blocks:
                asks = cut(_with_floors(asks, found, k))
        return found

    everything = {"lows": F.array(F.lit(LEAST).cast("long")), "highs": F.array(F.lit(GREATEST))}
    same = search(asked.withColumns(everything), positives + 1, True).join(members, "class_id").join(asked.select("ask_id", "anchor_id"), "ask_id").where("vec_id <> anchor_id")
    best = Window.partitionBy("ask_id").orderBy(F.desc("score"), "vec_id")
    pairs = same.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= positives).select("ask_id", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # Of a score below zero, the lower end of the range lies above the upper: it has no negatives.
    low = F.expr(f"CAST((CAST(positive_score AS DECIMAL(20, 0)) * {least_percent} + 99) DIV 100 AS BIGINT)")
    pairs = cut(pairs.where("positive_score >= 0").withColumn("low", low))
    ends = F.sort_array(F.collect_set(F.struct("positive_score", "low")), asc=False)
    ranges = pairs.groupBy("ask_id").agg(ends.alias("ends")).select("ask_id", F.col("ends.low").alias("lows"), F.col("ends.positive_score").alias("highs"))
    other = search(cut(asked.join(ranges, "ask_id")), negatives, False).join(members, "class_id")
    found = pairs.join(other.select("ask_id", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), "ask_id").where("negative_score BETWEEN low AND positive_score")
    rank = F.row_number().over(Window.partitionBy("ask_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE_SQL = """
WITH usable AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), positive AS (
  SELECT anchor_id, vec_id, score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 5
"""
