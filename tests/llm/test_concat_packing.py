"""Concatenate and cut: every id lies in one piece, and pieces and sequences equal a plain concatenation."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioweave.llm import concat_packing

SCHEMA = "doc_id long, text string, offset string, part string, ids string"


TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def corpus(n=60):
    r = random.Random(4)
    rows = [(k, " ".join(r.choice(("alpha", "béta", "γ", "x", "1234", "\n\n")) for _ in range(r.randrange(120)))) for k in range(n)]
    rows += [(n, None), (n + 1, ""), (None, "no id"), (5, rows[5][1]), (5, rows[5][1]), (n + 2, "long " * 9000), (n + 3, "<|endoftext|> ß"), (n + 4, "x" * 5000)]
    return [(i, t, "a", "b", "c") for i, t in rows]


@pytest.mark.parametrize("capacity", [2048, 64, 7])
def test_pieces_hold_each_id_once(spark, capacity):
    rows = corpus()
    got = concat_packing.packed(spark.createDataFrame(rows, SCHEMA).repartition(5), capacity=capacity).collect()
    texts = {i: plain_ids(t) for i, t, *_ in rows}
    copies = {i: sum(x[0] == i for x in rows) for i in texts}
    by_doc, by_sequence = {}, {}
    for x in got:
        ids = texts[x["doc_id"]]
        assert x["doc_tokens"] == len(ids)
        assert x["ids_crc32"] == zlib.crc32(np.array(ids[x["start"] : x["start"] + x["length"]], "<u4").tobytes())
        by_doc.setdefault(x["doc_id"], []).extend(range(x["start"], x["start"] + x["length"]))
        by_sequence.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    assert {i: sorted(x) for i, x in by_doc.items()} == {i: sorted(list(range(len(x))) * copies[i]) for i, x in texts.items()}
    total = sum(len(texts[i]) * c for i, c in copies.items())
    lengths = {}
    for s, parts in by_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        lengths[s] = at
    assert sorted(lengths) == list(range(len(lengths)))
    whole = [s for s, n in lengths.items() if n == capacity]
    assert len(whole) >= total // capacity and sum(lengths.values()) == total
    assert all(n & (n - 1) == 0 for n in lengths.values() if n != capacity)


def test_sequences_are_the_pieces_in_place(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(7, "doc_id").cache()
    sequences = {x["sequence_id"]: np.frombuffer(x["ids"], "<u4") for x in concat_packing.sequences(docs, capacity=50).collect()}
    pieces = concat_packing.packed(docs, capacity=50).collect()
    assert {x["sequence_id"] for x in pieces} == set(sequences)
    assert sum(map(len, sequences.values())) == sum(x["length"] for x in pieces)
    for x in pieces:
        assert zlib.crc32(sequences[x["sequence_id"]][x["offset"] : x["offset"] + x["length"]].tobytes()) == x["ids_crc32"]


def test_origins_of_many_parts(spark):
    r = random.Random(1)
    rows = [(part, r.randrange(50)) for part in range(0, 300, 3) for _ in range(r.randrange(1, 4))]
    got = {x["part"]: (x["origin"], x["total"]) for x in concat_packing.part_origins(spark.createDataFrame(rows, "part long, n long"), group=7).collect()}
    want, at = {}, 0
    for part in sorted({p for p, _ in rows}):
        n = sum(k for p, k in rows if p == part)
        want[part], at = (at, n), at + n
    assert got == want


def test_the_rest_is_cut_into_powers_of_two():
    w = concat_packing.Windows(3 * 2048 + 1000, 2048)
    assert [n for _, n, _, _ in w.cuts(0, 3 * 2048 + 1000)] == [2048] * 3 + [512, 256, 128, 64, 32, 8]
    assert list(w.cuts(2047, 2)) == [(0, 1, 0, 2047), (1, 1, 1, 0)]


def test_nothing_to_pack(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert concat_packing.packed(empty).collect() == [] and concat_packing.sequences(empty).collect() == []
