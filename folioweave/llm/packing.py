"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Pieces are dealt by hash into shards of a few thousand, each packed by one task, so no task
grows with the corpus; a shard wastes less than one sequence against packing all at once.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END_ID = 0
CAPACITY = 2048
SHARD_PIECES = 4096
PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"
#: Finds what a pattern may not split: thousands of characters of one kind, black or white.
LONG_RUN = re.compile(r"\S{2000}|\s{2000}").search
_loaded: dict[tuple[str, str], Encoder] = {}


class Encoder:
    """Token ids of whole texts, by a file of byte-level ranks and its usual splitting pattern.

    The ids are those of the same vocabulary's tokenizer file. That file itself encodes texts
    with a run too long for the ranks and texts that hold the string of a special token.
    """

    def __init__(self, ranks: str, whole: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as f:
            known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        self.tokenizer = Tokenizer.from_file(whole)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))).search if special else lambda text: None

    @classmethod
    def of(cls, ranks: str, whole: str) -> Encoder:
        if (ranks, whole) not in _loaded:
            _loaded[ranks, whole] = cls(ranks, whole)
        return _loaded[ranks, whole]

    def __call__(self, text: str) -> np.ndarray:
        if LONG_RUN(text) or self.special(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """Starts and lengths of a document's pieces; what a whole number of capacities leaves over comes first."""
    first = length % capacity
    return ([(0, first)] if first else []) + [(x, capacity) for x in range(first, length, capacity)]


def pieces(docs: DataFrame, ranks: str | None = None, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document: the ids' place, number and checksum, without the ids.

    A null or empty text is the end id alone.
    """
    if ranks is None or tokenizer is None:
        import public_tokenizers

        ranks, tokenizer = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")

    kind = docs.schema["doc_id"].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(ranks, tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for doc, text in enumerate(part.column("text").to_pylist()):
                    ids = np.append(encoder(text or ""), np.uint32(END_ID)).astype("<u4")
                    rows += [(doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cuts(len(ids), capacity))]
                doc, *rest = np.array(rows, np.int64).T
                columns = [part.column("doc_id").take(pa.array(doc)), *(pa.array(x, t) for x, t in zip(rest, (pa.int32(), *[pa.int64()] * 3), strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(encode, PIECES.format(id=kind.simpleString()))


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length. Lengths are counted, so a bin costs what there are different lengths.

    A bin takes the longest piece that fits until none does. Then its smallest piece is
    exchanged for the two unpacked ones that fill the gap it leaves best, if they fill more.
    """
    left = np.bincount(lengths, minlength=capacity + 1)
    slots: dict[int, list[tuple[int, int]]] = {}
    bins, remaining = 0, len(lengths)
    while remaining:
        gap, packed = capacity, []
        while True:
            fits = np.flatnonzero(left[: gap + 1])
            if not len(fits) or not gap:
                break
            packed.append(int(fits[-1]))
            left[packed[-1]] -= 1
            gap -= packed[-1]
        if gap and len(packed) > 1 and (pair := _pair(left, gap + packed[-1], packed[-1])):
            left[packed.pop()] += 1
            for x in pair:
                left[x] -= 1
            packed += pair
        remaining -= len(packed)
        offset = 0
        for x in packed:
            slots.setdefault(x, []).append((bins, offset))
            offset += x
        bins += 1
    bin_of, offset_of = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, x in enumerate(lengths):
        bin_of[k], offset_of[k] = slots[int(x)].pop()
    return bin_of, offset_of


def _pair(left: np.ndarray, room: int, beat: int) -> list[int] | None:
    """The two unpacked lengths with the greatest sum from beat + 1 to room."""
    a = np.flatnonzero(left[:room])
    if not len(a):
        return None
    best = np.searchsorted(a, room - a, side="right") - 1  # the longest partner of each
    single = (best >= 0) & (a[best] == a) & (left[a] < 2)
    best -= single
    ok = best >= 0
    total = np.where(ok, a + a[best], -1)
    k = int(total.argmax())
    return [int(a[k]), int(a[best[k]])] if total[k] > beat else None


def pack(found: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces.

    Whole sequences need no packing. The rest go to shards by a hash of document and piece,
    so copies of a text spread over all shards.
    """
    whole, rest = found.where(F.col("length") == capacity), found.where(F.col("length") < capacity)
    shards = max(1, -(-rest.count() // shard_pieces))
    id_type = found.schema["doc_id"].dataType.simpleString()

    def fill(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part = part.sort_by([(x, "ascending") for x in ("length", "ids_crc32", "doc_id", "piece")]).drop_columns("shard")
        bins, offsets = best_two_fit(part["length"].to_numpy(), capacity)
        return part.append_column("sequence_id", pa.array(bins * shards + key[0].as_py())).append_column("offset", pa.array(offsets))

    out = PIECES.format(id=id_type) + ", sequence_id long, offset long"
    packed = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards))).groupBy("shard").applyInArrow(fill, out)
    # Numbers below zero: a whole sequence is its own; its place in the frame numbers it.
    return packed.unionByName(whole.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")))


def packed_sequences(docs: DataFrame, ranks: str | None = None, tokenizer: str | None = None, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Repeated rows are
    packed each; a null doc_id is kept; an empty table gives no rows. Pieces are checkpointed
    before packing, so a lost executor doesn't cost the tokenizing.
    """
    from .common import cut

    return pack(cut(pieces(docs, ranks, tokenizer, capacity)), capacity, shard_pieces)
