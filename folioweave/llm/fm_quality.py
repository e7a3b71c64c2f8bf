"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

The score of a text with features x is
    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),
so all pairwise interactions cost time linear in the number of features.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

WORD_BUCKETS = 1 << 15
BINS = 12
STATISTICS = 12
FEATURES = WORD_BUCKETS + STATISTICS * BINS
FACTORS = 8
#: Bound of the sample of labelled rows that the machine learns from.
MAX_TRAINING_ROWS = 24_000
WORKERS, ROUNDS, EPOCHS = 6, 4, 2
#: A worker for so many rows, and gradient steps that it takes in a round at least.
ROWS_PER_WORKER, BATCH, LEAST_STEPS = 2_000, 64, 100
PREDICT_AT = 0.7
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def structure(text: str, raw: bytes, words: list[bytes], counts: Counter, n_chars: float | None) -> np.ndarray:
    """STATISTICS numbers of about 0 to 1: shape of a text, and the table's own length of it."""
    used = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(len(words), 1)
    upper, lower, digits = used[65:91].sum(), used[97:123].sum(), used[48:58].sum()
    high = used[128:].sum()
    shown = max(int(used[33:].sum()), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    return np.array([
        np.log1p(len(words)) / 10,
        min(shown / n / 20, 1),
        min(used[SYMBOLS].sum() / n, 1),
        upper / max(upper + lower, 1),
        (used[33:127].sum() - digits - upper - lower) / shown,
        digits / shown,
        min((used[33] + used[46] + used[63]) / n, 1),
        1 - len(set(lines)) / max(len(lines), 1),
        len(counts) / n,
        high / shown,
        min(len(lines) / n * 5, 1),
        np.log1p(max(n_chars, 0)) / 14 if n_chars is not None and n_chars == n_chars else 0.0,
    ])


def features(text: str | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values: words by hash with damped counts of unit length, a bin of each statistic."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    counts = Counter(words)
    at = np.array([zlib.crc32(w) & (WORD_BUCKETS - 1) for w in counts], np.int32)
    x = np.sqrt(np.fromiter(counts.values(), np.float32, len(counts)))
    if len(x):
        x /= np.linalg.norm(x)
    bins = np.minimum(np.sqrt(np.clip(structure(text, raw, words, counts, n_chars), 0, 1)) * BINS, BINS - 1).astype(np.int32)
    own = WORD_BUCKETS + BINS * np.arange(STATISTICS, dtype=np.int32) + bins
    return np.concatenate([at, own]), np.concatenate([x, np.full(STATISTICS, 0.5, np.float32)])


class Machine:
    """Weights and factors; rows come as feature numbers, values and where each row starts."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray) -> None:
        self.w0, self.w, self.v = w0, w, v

    @classmethod
    def fresh(cls, seed: int = 7) -> Machine:
        return cls(0.0, np.zeros(FEATURES, np.float32), np.random.default_rng(seed).normal(0, 0.02, (FEATURES, FACTORS)).astype(np.float32))

    def _forward(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.v[at] * x[:, None]
        sums = np.add.reduceat(vx, starts)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        linear = np.add.reduceat(self.w[at] * x, starts)
        return self.w0 + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), vx, sums

    def probability(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._forward(at, x, starts)[0].astype(np.float64), -30, 30)))

    def learn(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int, seed: int, batch: int = BATCH, rate: float = 0.1, decay: float = 1e-5) -> None:
        """Adagrad on the logistic loss."""
        epochs = max(epochs, -(-LEAST_STEPS * batch // max(len(rows), batch)))
        g0, gw, gv = 1e-2, np.full(len(self.w), 1e-2, np.float32), np.full(self.v.shape, 1e-2, np.float32)
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            turn = order.permutation(len(rows))
            for k in range(0, len(turn), batch):
                own = turn[k : k + batch]
                sizes = np.array([len(rows[i][0]) for i in own])
                at, x = np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                score, vx, sums = self._forward(at, x, starts)
                error = ((1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[own]) / len(own)).astype(np.float32)
                each = np.repeat(np.arange(len(own)), sizes)
                by_row = error[each] * x
                used, place = np.unique(at, return_inverse=True)
                dw = np.bincount(place, by_row, len(used)).astype(np.float32) + decay * self.w[used]
                dv = np.zeros((len(used), self.v.shape[1]), np.float32)
                np.add.at(dv, place, by_row[:, None] * (sums[each] - vx))
                dv += decay * self.v[used]
                g0 += float(error.sum()) ** 2
                gw[used] += dw * dw
                gv[used] += dv * dv
                self.w0 -= rate * float(error.sum()) / g0**0.5
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * dv / np.sqrt(gv[used])


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """Features and label of at most about ``max_rows`` labelled rows outside the held-out quarter, drawn by a hash of doc_id.

    The sample is small enough to be broadcast to the documents, so no text is shuffled.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("y"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    share = min(1.0, max_rows / max(known.count(), 1))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t, n) for t, n in zip(b.column("text").to_pylist(), b.column("n_chars").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32())), b.column("y").cast(pa.int32())], ["at", "x", "y"])

    joined = docs.select("doc_id", "text", "n_chars").join(F.broadcast(sample), "doc_id").select("text", "n_chars", "y")
    return joined.mapInArrow(build, "at array<int>, x array<float>, y int")


def dealt(rows: DataFrame, workers: int) -> DataFrame:
    """The rows dealt to workers by a hash of what they hold, each worker's in the order of that hash.

    Neither the order of the input files nor a stage run again changes who learns what, and when.
    """
    keyed = rows.withColumn("deal", F.xxhash64("at", "x", "y"))
    return keyed.repartition(workers, "deal").sortWithinPartitions("deal").drop("deal")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, workers: int = WORKERS, rounds: int = ROUNDS, epochs: int = EPOCHS) -> Machine:
    """Learns by iterative parameter mixing: each round every worker improves the shared machine on its own rows, and the results are averaged.

    Only the machines travel, about 1 MB for each worker. Without labelled rows the machine scores 0.5.
    """
    spark = docs.sparkSession
    rows = cut(dealt(training_rows(docs, labels, max_rows), workers))
    shared, n = Machine.fresh(), rows.count()
    rows = rows.coalesce(max(1, min(workers, n // ROWS_PER_WORKER)))
    if not n:
        shared.v[:] = 0
        return shared
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((shared.w0, shared.w, shared.v))

        def improve(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            own, y = [], []
            for b in batches:
                y += b.column("y").to_pylist()
                own += [(np.array(a, np.int32), np.array(x, np.float32)) for a, x in zip(b.column("at").to_pylist(), b.column("x").to_pylist(), strict=True)]
            if own:
                w0, w, v = sent.value
                m = Machine(w0, w.copy(), v.copy())
                m.learn(own, np.array(y, np.float32), epochs, seed=turn)
                yield pa.RecordBatch.from_arrays([pa.array([len(own)], pa.int64()), pa.array([float(m.w0)]), pa.array([m.w.tobytes()]), pa.array([m.v.tobytes()])], ["n", "w0", "w", "v"])

        found = rows.mapInArrow(improve, "n long, w0 double, w binary, v binary").collect()
        share = np.array([r["n"] for r in found], float)
        share /= share.sum()
        shared = Machine(
            float(sum(s * r["w0"] for s, r in zip(share, found, strict=True))),
            sum(s * np.frombuffer(r["w"], np.float32) for s, r in zip(share, found, strict=True)).astype(np.float32),
            sum(s * np.frombuffer(r["v"], np.float32) for s, r in zip(share, found, strict=True)).reshape(FEATURES, FACTORS).astype(np.float32),
        )
    return shared


def score_quality(docs: DataFrame, labels: DataFrame, **how: int) -> DataFrame:
    """doc_id, held_out, score, predicted for every document, in one pass over whole texts.

    Null and empty texts are scored by their empty structure; a null n_chars counts as 0; a
    null doc_id isn't held out. doc_id, lang, source and labels are no inputs of a score.
    """
    machine = train(docs, labels, **how)
    sent = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w, machine.v))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*sent.value)
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                b = whole.slice(k, 64)
                found = [features(t, n) for t, n in zip(b.column("text").to_pylist(), b.column("n_chars").to_pylist(), strict=True)]
                starts = np.cumsum([0, *[len(f[0]) for f in found]])[:-1]
                p = m.probability(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), starts)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text", "n_chars").mapInArrow(judge, f"doc_id {kind}, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
