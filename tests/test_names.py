"""Names in texts, where ids repeat and where they don't."""

import pytest

from folioweave.operators import references


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_repeated_and_null_ids_count_once(spark, monkeypatch, most):
    monkeypatch.setattr(references, "MOST_BROADCAST", most)
    rows = [(1, "france and peru"), (1, "Peru, peru; chad"), (2, "france"), (None, "peru mali"), (None, "mali"), (3, None), (4, "chad")]
    names = spark.createDataFrame([("PERU",), ("peru",), ("France",), ("mali",), ("chad",), ("cuba",)], "name string")
    got = references.names_in_texts(spark.createDataFrame(rows, "doc_id long, text string"), names)
    assert sorted(map(tuple, got.collect())) == [("chad", 2), ("france", 2), ("mali", 0), ("peru", 1)]


def test_words_are_counted_before_any_shuffle(spark):
    """No task holds pairs of word and document where no id repeats."""
    docs = spark.createDataFrame([(k, "france and peru") for k in range(9)], "doc_id long, text string")
    plan = references.names_in_texts(docs, spark.createDataFrame([("peru",)], "name string"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "count(distinct" not in plan and "hashpartitioning(name" in plan and "hashpartitioning(doc_id" not in plan
