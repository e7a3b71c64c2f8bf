"""Git repositories by path: a data source of their objects, loose and packed, and commits with their line counts."""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.alignment import matches
from ..session import cut

#: The types of packed objects by number.
TYPES = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
OFFSET_DELTA, REF_DELTA = 6, 7
OBJECTS = "hash string, type string, content binary"
PER_PARTITION = 5000


def index_of(pack: str) -> tuple[list[bytes], list[int]]:
    """Names and offsets of a pack's objects, by its index (version 2)."""
    with open(pack[:-4] + "idx", "rb") as f:
        data = f.read()
    if data[:8] != b"\xfftOc\0\0\0\2":
        raise ValueError(f"no index of version 2 beside {pack}")
    n = struct.unpack_from(">I", data, 8 + 255 * 4)[0]
    names = [data[1032 + 20 * k : 1052 + 20 * k] for k in range(n)]
    small, large = 1032 + 24 * n, 1032 + 28 * n
    offsets = [x if x < 1 << 31 else struct.unpack_from(">Q", data, large + 8 * (x - (1 << 31)))[0] for x in struct.unpack_from(f">{n}I", data, small)]
    return names, offsets


class Pack:
    """Objects of a pack, by offset; deltas are applied to their bases, of which the last few stay in memory."""

    def __init__(self, path: str) -> None:
        self.names, self.offsets = index_of(path)
        self.at = dict(zip(self.names, self.offsets, strict=True))
        self.file, self.held = open(path, "rb"), {}

    def object(self, offset: int) -> tuple[str, bytes]:
        chain, found = [], self.held.get(offset)
        while found is None:
            kind, base, data = self._entry(offset)
            if kind in TYPES:
                found = TYPES[kind], data
            else:
                chain.append((offset, data))
                offset = base
                found = self.held.get(offset)
        for at, delta in reversed(chain):
            found = found[0], applied(found[1], delta)
            if len(self.held) >= 256:
                self.held.pop(next(iter(self.held)))
            self.held[at] = found
        return found

    def _entry(self, offset: int) -> tuple[int, int, bytes]:
        self.file.seek(offset)
        byte = self.file.read(1)[0]
        kind, size, shift = byte >> 4 & 7, byte & 15, 4
        while byte & 128:
            byte = self.file.read(1)[0]
            size, shift = size | (byte & 127) << shift, shift + 7
        base = -1
        if kind == OFFSET_DELTA:
            byte = self.file.read(1)[0]
            back = byte & 127
            while byte & 128:
                byte = self.file.read(1)[0]
                back = (back + 1) << 7 | byte & 127
            base = offset - back
        elif kind == REF_DELTA:
            base = self.at[self.file.read(20)]
        inflate, out = zlib.decompressobj(), b""
        while not inflate.eof:
            out += inflate.decompress(self.file.read(max(4096, size // 2)))
        return kind, base, out


def applied(base: bytes, delta: bytes) -> bytes:
    """What a delta makes of its base: pieces copied from it, and new ones."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = delta[at]
            at += 1
            value, shift = value | (byte & 127) << shift, shift + 7
            if not byte & 128:
                return value

    number()
    size, out = number(), bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 128:
            place = length = 0
            for k in range(7):
                if op >> k & 1:
                    if k < 4:
                        place |= delta[at] << 8 * k
                    else:
                        length |= delta[at] << 8 * (k - 4)
                    at += 1
            out += base[place : place + (length or 1 << 16)]
        else:
            out += delta[at : at + op]
            at += op
    if len(out) != size:
        raise ValueError("a delta doesn't fit its base")
    return bytes(out)


@dataclass
class Part(InputPartition):
    path: str
    begun: int
    ended: int
    names: tuple[str, ...] = ()


class ObjectReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = os.path.join(path, ".git") if os.path.isdir(os.path.join(path, ".git")) else path

    def partitions(self) -> list[Part]:
        """Ranges of each pack's objects in the order of offsets, and groups of loose ones."""
        folder, found = os.path.join(self.path, "objects"), []
        packs = os.path.join(folder, "pack")
        for name in sorted(os.listdir(packs)) if os.path.isdir(packs) else []:
            if name.endswith(".pack"):
                n = len(index_of(os.path.join(packs, name))[0])
                found += [Part(os.path.join(packs, name), k, min(k + PER_PARTITION, n)) for k in range(0, n, PER_PARTITION)]
        loose = [f"{d}/{x}" for d in sorted(os.listdir(folder)) if len(d) == 2 for x in sorted(os.listdir(os.path.join(folder, d))) if len(x) == 38]
        return found + [Part(folder, 0, 0, tuple(loose[k : k + PER_PARTITION])) for k in range(0, len(loose), PER_PARTITION)]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.names:
            for name in partition.names:
                with open(os.path.join(partition.path, name), "rb") as f:
                    head, _, content = zlib.decompress(f.read()).partition(b"\0")
                yield name.replace("/", ""), head.split()[0].decode(), content
        elif partition.path.endswith(".pack"):
            pack = Pack(partition.path)
            for offset, name in sorted(zip(pack.offsets, pack.names, strict=True))[partition.begun : partition.ended]:
                yield name.hex(), *pack.object(offset)


class GitObjects(DataSource):
    """``spark.read.format("git_objects").load(path)``: the objects of a repository, from a folder that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "git_objects"

    def schema(self) -> str:
        return OBJECTS

    def reader(self, schema) -> ObjectReader:
        return ObjectReader(self.options["path"])


def objects(spark: SparkSession, path: str) -> DataFrame:
    """hash, type, content of each object, once, however often it is stored."""
    spark.dataSource.register(GitObjects)
    return spark.read.format("git_objects").load(path).dropDuplicates(["hash"])


def object_hash(kind: str, content: bytes) -> str:
    return hashlib.sha1(f"{kind} {len(content)}\0".encode() + content).hexdigest()


def commits(found: DataFrame) -> DataFrame:
    """hash, tree, parents, author, email, timestamp, message of the commits among objects."""
    text = F.decode("content", "UTF-8")
    each = found.where("type = 'commit'").select("hash", text.alias("text"))
    line = lambda p, k=1: F.regexp_extract("text", rf"(?m)^{p}", k)
    return each.select(
        "hash", line("tree ([0-9a-f]+)").alias("tree"), F.regexp_extract_all(F.substring_index("text", "\n\n", 1), F.lit("(?m)^parent ([0-9a-f]+)"), F.lit(1)).alias("parents"),
        line("author (.*?) <").alias("author"), line("author .*?<([^>]*)>").alias("email"), F.timestamp_seconds(line(r"author .*?> (\d+)").cast("long")).alias("timestamp"),
        F.regexp_replace(F.expr("substring(text, instr(text, '\n\n') + 2)"), "\n$", "").alias("message"),
    )


def tree_entries(found: DataFrame) -> DataFrame:
    """tree, name, folder, hash: what the trees among objects hold; links to other repositories are left out."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree, data in zip(batch["hash"].to_pylist(), batch["content"].to_pylist(), strict=True):
                at = 0
                while at < len(data):
                    end = data.index(b"\0", at)
                    mode, name = data[at:end].split(b" ", 1)
                    if mode != b"160000":
                        rows.append((tree, name.decode("utf-8", "replace"), mode == b"40000", data[end + 1 : end + 21].hex()))
                    at = end + 21
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.bool_(), pa.string()), strict=True)], ["tree", "name", "folder", "hash"])

    return found.where("type = 'tree'").select("hash", "content").mapInArrow(parse, "tree string, name string, folder boolean, hash string")


def changed_files(found: DataFrame) -> DataFrame:
    """commit, path, old, new: the files that each commit of at most one parent adds, changes or removes, with the hashes of both contents.

    Trees are compared from the top, a level a round: only folders that differ are opened.
    """
    c, entries = cut(commits(found).where("size(parents) <= 1").select("hash", "tree", F.get("parents", F.lit(0)).alias("parent"))), cut(tree_entries(found))
    roots = c.join(c.select(F.col("hash").alias("parent"), F.col("tree").alias("old")).unionByName(commits(found).where("size(parents) > 1").select(F.col("hash").alias("parent"), F.col("tree").alias("old"))), "parent", "left")
    open_ = cut(roots.select(F.col("hash").alias("commit"), F.lit("").alias("prefix"), "old", F.col("tree").alias("new")).where("NOT old <=> new"))
    files = None
    while not open_.isEmpty():
        side = lambda s: open_.where(F.col(s).isNotNull()).join(entries, F.col(s) == F.col("tree")).select("commit", "prefix", "name", "folder", F.col("hash").alias(f"{s}_hash"))  # noqa: B023, E731
        met = cut(side("old").join(side("new"), ["commit", "prefix", "name", "folder"], "full_outer").where("NOT old_hash <=> new_hash"))
        path: Column = F.concat("prefix", "name")
        own = met.where("NOT folder").select("commit", path.alias("path"), F.col("old_hash").alias("old"), F.col("new_hash").alias("new"))
        files = own if files is None else files.unionByName(own)
        open_ = cut(met.where("folder").select("commit", F.concat(path, F.lit("/")).alias("prefix"), F.col("old_hash").alias("old"), F.col("new_hash").alias("new")))
    return files if files is not None else open_.select("commit", F.col("prefix").alias("path"), "old", "new")


def numstat(found: DataFrame) -> DataFrame:
    """commit, path, status, additions, deletions of each changed file by a shortest difference; null counts for binary files."""
    blobs = found.where("type = 'blob'").select("hash", "content")
    files = changed_files(found)
    pairs = cut(files.select("old", "new").distinct())
    read = pairs.join(blobs.select(F.col("hash").alias("old"), F.col("content").alias("a")), "old", "left").join(blobs.select(F.col("hash").alias("new"), F.col("content").alias("b")), "new", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                a, b = a or b"", b or b""
                if b"\0" in a[:8000] or b"\0" in b[:8000]:
                    rows.append((None, None))
                else:
                    x, y = ([*t.split(b"\n")[:-1], *([(t.rsplit(b"\n", 1)[-1], "open")] if not t.endswith(b"\n") and t else [])] for t in (a, b))
                    same = len(matches(x, y))
                    rows.append((len(y) - same, len(x) - same))
            added, removed = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch["old"], batch["new"], pa.array(added, pa.int64()), pa.array(removed, pa.int64())], ["old", "new", "additions", "deletions"])

    counts = read.mapInArrow(count, "old string, new string, additions long, deletions long")
    met = files.join(counts.withColumnsRenamed({"old": "o", "new": "n"}), F.col("old").eqNullSafe(F.col("o")) & F.col("new").eqNullSafe(F.col("n")))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified")
    return met.select("commit", "path", status.alias("status"), "additions", "deletions")
