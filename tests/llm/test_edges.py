"""Best-two-fit packing against a plain version, and odd rows and tables through packing, SimHash and the pipeline."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from folioweave.llm import packing, quality_rules, simhash_dedup

SCHEMA = "doc_id long, text string, sequence_id string, fp string, component_id string, offset string, lang string, source string, n_chars long"


def plain_best_two_fit(lengths, capacity):
    """The same rule over a sorted list, a bin at a time: lengths of each bin."""
    left, bins = sorted(lengths), []
    while left:
        gap, packed = capacity, []
        while gap and (fits := [x for x in left if x <= gap]):
            packed.append(fits[-1])
            left.remove(fits[-1])
            gap -= fits[-1]
        if gap and len(packed) > 1:
            small = packed[-1]
            sums = [(left[i] + left[j], i, j) for i in range(len(left)) for j in range(i) if small < left[i] + left[j] <= gap + small]
            if sums:
                best = max(sums)[0]
                pair = next((left[i], left[j]) for t, i, j in sums if t == best)
                packed.pop()
                left.append(small)
                for x in pair:
                    left.remove(x)
                left.sort()
                packed += pair
        bins.append(packed)
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_bins_are_as_full_as_the_plain_versions(seed):
    r = random.Random(seed)
    lengths = [r.randrange(1, r.choice((20, 64))) for _ in range(r.randrange(1, 80))]
    bin_of, offset_of = packing.best_two_fit(np.array(lengths), 64)
    bins = {}
    for x, b, o in zip(lengths, bin_of, offset_of, strict=True):
        bins.setdefault(int(b), []).append((int(o), x))
    for parts in bins.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:k]) for k, (o, _) in enumerate(parts)) and sum(n for _, n in parts) <= 64
    assert len(bins) <= len(plain_best_two_fit(lengths, 64)) + 1


def test_bins_are_few():
    r = random.Random(9)
    lengths = np.array([min(2048, int(r.expovariate(1 / 500)) + 1) for _ in range(4096)])
    bins = packing.best_two_fit(lengths, 2048)[0].max() + 1
    assert bins <= 1.01 * -(-int(lengths.sum()) // 2048) + 1


def test_odd_rows_are_packed_each(spark):
    rows = [(1, "one two"), (1, "one two"), (None, "no id"), (None, None), (2, ""), (3, "long " * 5000)]
    got = packing.packed_sequences(spark.createDataFrame([(i, t, *["x"] * 6, 0) for i, t in rows], SCHEMA)).collect()
    assert Counter(x["doc_id"] for x in got if x["piece"] == 0) == Counter(i for i, _ in rows)
    assert max(x["length"] for x in got) == 2048 and len({x["sequence_id"] for x in got}) == -(-sum(x["length"] for x in got) // 2048)
    assert packing.packed_sequences(spark.createDataFrame([], SCHEMA)).collect() == []


def test_odd_rows_have_fingerprints(spark):
    text = "a few words that are the same in both of these texts"
    rows = [(7, text), (3, text), (3, text), (None, text), (None, "quite another text of other words altogether here"), (9, None), (8, "  \n"), (5, "word " * 40_000), (6, "word " * 40_001)]
    docs = spark.createDataFrame([(i, t, *["x"] * 6, 0) for i, t in rows], SCHEMA)
    got = Counter((x["doc_id"], x["component_id"]) for x in simhash_dedup.near_duplicate_components(docs).collect())
    assert got == Counter({(7, 3): 1, (3, 3): 2, (None, 3): 1, (None, None): 1, (9, 8): 1, (8, 8): 1, (5, 5): 1, (6, 5): 1})
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns and Counter(x["doc_id"] for x in kept.collect()) == Counter([3, 3, None, None, 8, 5])
    assert simhash_dedup.near_duplicate_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_the_pipeline_of_an_empty_table_is_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_pipeline_takes_odd_rows(spark, tmp_path):
    known = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    good = max((x["text"] for x in quality_rules.quality_filter(known).collect()), key=len)
    rows = [(k + 100, x["text"]) for k, x in enumerate(known.collect())] + [(1, good), (1, good), (None, good + " and more of it"), (2, None), (3, ""), (4, "short")]
    frame = spark.createDataFrame([(i, t, "en", None if i == 1 else "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    found = Counter(x["doc_id"] for x in got)
    # Both rows of the smallest id of the copies stay, and rows without an id, which can't be told apart.
    assert found[1] >= 2 and found[None] >= 1 and not {2, 3, 4} & set(found)
