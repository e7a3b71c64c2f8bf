"""The change feed, whole and followed, and deletion that rewrites what it touches alone."""

import glob
import hashlib
import json

from pyspark.sql import functions as F

from folioweave.operators import retention
from folioweave.sources import changes


def page(folder, token, *ids):
    docs = [{"documentId": i, "title": f"{i} at {token}", "body": {"content": []}, "comments": [{"author": "A", "content": "é"}]} for i in ids]
    (folder / f"{token:08d}.json").write_text(json.dumps(docs, ensure_ascii=False), encoding="utf-8")


def test_following_a_feed_equals_reading_it(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "PER_PARTITION", 2)
    feed = tmp_path / "feed"
    feed.mkdir()
    (feed / "notes.txt").write_text("no page")

    def follow():
        stream = changes.changes(spark, str(feed), follow=True).select("token", "documentId", "title")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds").start()
        q = spark.streams.active[-1]
        q.processAllAvailable()
        q.stop()
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    whole = lambda: sorted(tuple(r) for r in changes.changes(spark, str(feed)).select("token", "documentId", "title").collect())
    for k in range(1, 6):
        page(feed, k, "a", f"d{k}")
    assert follow() == whole() and len(whole()) == 10
    page(feed, 6, "a")
    page(feed, 9, "d1", "e")
    assert follow() == whole() and len(whole()) == 13  # a restart goes on after token 5
    assert {r["documentId"]: r["title"] for r in changes.latest(changes.changes(spark, str(feed))).collect()}["a"] == "a at 6"
    assert changes.changes(spark, str(feed)).first()["comments"][0]["content"] == "é"


def test_deletion_rewrites_only_what_it_touches(spark, tmp_path):
    path, schema = str(tmp_path / "history"), "author long, text string"
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 100)
    try:
        frame = spark.range(2000).select((F.col("id") % 50).alias("author"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
        retention.append(frame.where("author < 40"), path, "author")
        retention.append(frame.where("author >= 40"), path, "author")
        before = {f: hashlib.md5(open(f, "rb").read()).hexdigest() for f in glob.glob(f"{path}/data/*/*.parquet")}
        old = retention.current(spark, path, schema)
        gone = spark.createDataFrame([(3, "x"), (45, "y"), (None, "z"), (77, "w")], "author long, why string")
        rewritten, kept = retention.delete(spark, path, schema, gone, "author")
        assert 2 <= rewritten <= 6 and rewritten + kept == len(before)
        assert {f: hashlib.md5(open(f, "rb").read()).hexdigest() for f in before} == before
        assert len({r["file"] for r in retention.files(spark, path).collect()} & {r["file"] for r in retention.files(spark, path, 2).collect()}) == kept
        want = sorted(tuple(r) for r in frame.where("author not in (3, 45)").collect())
        assert sorted(tuple(r) for r in retention.current(spark, path, schema).collect()) == want
        assert old.count() == retention.current(spark, path, schema, at=2).count() == 2000  # a reader of the old version still has it whole
        assert retention.delete(spark, path, schema, gone, "author")[0] == 0 and retention.version(spark, path) == 3
        everyone = frame.select("author").distinct()
        retention.delete(spark, path, schema, everyone, "author")
        assert retention.current(spark, path, schema).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
