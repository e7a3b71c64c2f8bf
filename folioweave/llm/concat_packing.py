"""Concatenate-and-cut packing of tokenised documents into sequences of a fixed length.

The first pass writes each document's ids with its place in its partition. Prefix sums over
the partitions' token totals then give every partition its place in the whole stream, and
the second pass cuts the stream at every ``capacity`` tokens. No task holds more than a
document and a sequence; only sequences that cross a partition's ends are put together
from boundary records.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, maybe_broadcast, stored
from .packing import Encoder

END_ID = 1
CAPACITY = 2048
#: Partition totals summed in one window; sums of such groups are summed in a second.
GROUP = 1024
#: Partitions whose places are broadcast, 16 bytes each; beyond that the join shuffles.
MOST_PARTS = 100_000
ENCODE_ROWS = 256


def tokenised(docs: DataFrame, ranks: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """doc_id, part, before, n, ids: each document's ids and end id, written to the shared folder.

    ``part`` is the partition, ``before`` how many tokens stand before the document there.
    Ids take two bytes each, or four where the vocabulary needs them.
    """
    import public_tokenizers

    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    names = ["doc_id", "part", "before", "n", "ids"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = Encoder.of(ranks, tokenizer), TaskContext.get().partitionId(), 0
        width = "<u2" if encoder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for batch in batches:
            for at in range(0, batch.num_rows, ENCODE_ROWS):
                rows = batch.slice(at, ENCODE_ROWS)
                ids = [np.append(encoder(text or ""), np.uint32(END_ID)).astype(width) for text in rows.column("text").to_pylist()]
                n = np.array([len(x) for x in ids], np.int64)
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                columns = [rows.column("doc_id"), pa.array(np.full(len(n), part, np.int64)), pa.array(starts), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, part long, before long, n long, ids binary"))


def part_origins(rows: DataFrame, group: int = GROUP) -> DataFrame:
    """part, origin, total: how many tokens of earlier partitions stand before each partition's."""
    before = lambda w: F.coalesce(F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = rows.groupBy("part").agg(F.sum("n").alias("total")).withColumn("group", F.floor(F.col("part") / group))
    groups = totals.groupBy("group").agg(F.sum("total").alias("total")).select("group", before(Window.orderBy("group")).alias("base"))
    within = totals.withColumn("before", before(Window.partitionBy("group").orderBy("part")))
    return within.join(groups, "group").select("part", (F.col("base") + F.col("before")).alias("origin"), "total")


def placed(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows with their place ``at`` in the whole stream, and the stream's length."""
    origins = cut(part_origins(rows))
    parts, total = origins.agg(F.count("*"), F.coalesce(F.sum("total"), F.lit(0))).first()
    found = rows.join(maybe_broadcast(origins.drop("total"), parts, MOST_PARTS), "part")
    return found.select("doc_id", (F.col("origin") + F.col("before")).alias("at"), "n", "ids"), int(total)


class Windows:
    """Where the stream's sequences start: every ``capacity`` tokens.

    What is left at the end is cut into powers of two, longest first, as a sequence of such
    a length needs no padding.
    """

    def __init__(self, total: int, capacity: int) -> None:
        self.capacity, self.whole = capacity, total // capacity
        rest, at, self.tail = total % capacity, self.whole * capacity, []
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                self.tail.append(at)
                at += 1 << bit
        self.tail.append(at)

    def of(self, at: int) -> tuple[int, int, int]:
        """Number, start and end of the sequence that holds place ``at``."""
        k = at // self.capacity
        if k < self.whole:
            return k, k * self.capacity, (k + 1) * self.capacity
        t = int(np.searchsorted(self.tail, at, side="right")) - 1
        return self.whole + t, self.tail[t], self.tail[t + 1]

    def cuts(self, at: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """start, length, sequence and offset of each piece of n tokens from place ``at``."""
        end, x = at + n, at
        while x < end:
            sequence, first, last = self.of(x)
            stop = min(last, end)
            yield x - at, stop - x, sequence, x - first
            x = stop


def _ids(buffer: bytes, n: int) -> np.ndarray:
    return np.frombuffer(buffer, "<u2" if len(buffer) == 2 * n else "<u4").astype("<u4", copy=False)


def packed(docs: DataFrame, ranks: str | None = None, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece of each document.

    Sequences have ``capacity`` tokens, but for the last tokens of all, whose sequences have
    lengths of powers of two: nothing is padded. A null or empty text is the end id alone; a
    null doc_id is kept; repeated rows are packed each; an empty table gives no rows; other
    columns are ignored. Ids are written before they are cut, so a lost executor costs no
    second tokenizing of what was written.
    """
    rows, total = placed(tokenised(docs, ranks, tokenizer))
    windows, names = Windows(total, capacity), ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, which = [], []
            for k, (at, n, buffer) in enumerate(zip(batch["at"].to_pylist(), batch["n"].to_pylist(), batch["ids"], strict=True)):
                ids = _ids(buffer.as_buffer(), n)
                for start, length, sequence, offset in windows.cuts(at, n):
                    which.append(k)
                    rows.append((start, length, zlib.crc32(ids[start : start + length]), n, sequence, offset))
            if rows:
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(which)), *map(pa.array, np.array(rows, np.int64).T)], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(pieces, f"doc_id {kind}, " + ", ".join(f"{x} long" for x in names))


def sequences(docs: DataFrame, ranks: str | None = None, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, length, ids: the sequences themselves, ids as little-endian unsigned 32-bit numbers.

    A task fills the sequences whose tokens it reads in a row. What it has of others leaves it
    as boundary records, which are put together by sequence: at most ``capacity`` tokens each.
    """
    rows, total = placed(tokenised(docs, ranks, tokenizer))
    windows = Windows(total, capacity)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the open sequence, and where it and what comes next start
        begun = following = None

        def record() -> tuple[int, int, bool, bytes]:
            sequence, first, last = windows.of(begun)
            return sequence, begun - first, (begun, following) == (first, last), np.concatenate(held).tobytes()

        for batch in batches:
            out = []
            for at, n, buffer in zip(batch["at"].to_pylist(), batch["n"].to_pylist(), batch["ids"], strict=True):
                if held and at != following:
                    out.append(record())
                    held = []
                ids = _ids(buffer.as_buffer(), n)
                for start, length, sequence, _ in windows.cuts(at, n):
                    if held and windows.of(begun)[0] != sequence:
                        out.append(record())
                        held = []
                    begun = begun if held else at + start
                    held.append(ids[start : start + length])
                    following = at + start + length
            if out:
                yield _records(out)
        if held:
            yield _records([record()])

    found = rows.mapInArrow(fill, "sequence_id long, offset long, whole boolean, ids binary")
    parts = found.where("not whole").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = parts.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda done, x: F.concat(done, x["ids"])).alias("ids"))
    every = found.where("whole").select("sequence_id", "ids").unionByName(joined)
    return every.select("sequence_id", F.expr("CAST(octet_length(ids) / 4 AS BIGINT)").alias("length"), "ids")


def _records(rows: list[tuple[int, int, bool, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["sequence_id", "offset", "whole", "ids"])
