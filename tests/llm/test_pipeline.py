"""The pipeline's stages from Parquet, each held to what it promises on what the stage before kept."""

from collections import Counter

import corpus_pipeline
from folioweave.llm import line_dedup, quality_rules, simhash_dedup

SF = "/root/testdata/sf0.001"


def test_stages_keep_their_promises(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids, kept = docs.columns, {r["doc_id"] for r in docs.collect()}, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = kept[name] = spark.read.parquet(str(tmp_path / name))
        if name != "best-fit packing":
            assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} <= ids
        if name == "quality rules":
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in quality_rules.quality_report(before).where("kept").collect()}
        if name == "line dedup":
            # Taking lines out of a text leaves it a shorter one of the same lines; no class keeps two.
            assert docs.count() == before.count()
            old = {r["doc_id"]: (r["text"] or "").split("\n") for r in before.collect()}
            for r in docs.collect():
                rest = iter(old[r["doc_id"]])
                assert r["text"] is None or all(x in rest for x in r["text"].split("\n") if x) and r["n_chars"] == len(r["text"])
            again = line_dedup.line_report(docs).groupBy("class_id").count().where("count > 1").count()
            assert again <= 0.02 * line_dedup.line_report(before).select("class_id").distinct().count()
        if name == "SimHash near-dedup":
            found = simhash_dedup.near_duplicate_components(before).collect()
            assert {r["doc_id"] for r in docs.collect()} == {r["component_id"] for r in found}
        if name == "mixing sources to target weights":
            n = Counter(r["doc_id"] for r in docs.collect())
            assert set(n) == {r["doc_id"] for r in before.collect()} and max(n.values()) <= 2
        if name == "best-fit packing":
            rows = docs.collect()
            spans = {}
            for r in rows:
                spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            assert all(sum(n for _, n in x) <= 2048 and sorted(o for o, _ in x)[0] == 0 for x in spans.values())
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before.collect()}
    assert kept["SimHash near-dedup"].count() < kept["quality rules"].count() <= len(ids)
    assert corpus_pipeline.run(spark, SF).count() == kept["best-fit packing"].count()


def test_texts_reach_python_few_bytes_at_a_time(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(4000, numPartitions=1).selectExpr("repeat(string(id), 1250) as text")

    def sizes(batches):
        for b in batches:
            yield b.from_pydict({"n": [b.nbytes]})

    try:
        corpus_pipeline.batched(spark)
        found = [r[0] for r in docs.mapInArrow(sizes, "n long").collect()]
        assert len(found) > 1 and max(found) < 2 * corpus_pipeline.BATCH_BYTES
    finally:
        spark.conf.set(name, before)
