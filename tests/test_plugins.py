"""Plugins, hooks on a stream's batches, and the SQL functions."""

import pytest
from pyspark.sql import functions as F

from folioweave.functions import sql, text
from folioweave.operators import records
from folioweave.plugins import Plugins
from folioweave.streaming import replay


def test_plugins_are_open_and_run_in_order(spark):
    p = Plugins()
    p.register("double", lambda df, **_: df.withColumn("id", F.col("id") * 2))
    p.register("above", lambda df, least=0, **_: df.where(F.col("id") >= least))
    assert [r["id"] for r in p.apply(spark.range(5), "double", "above", least=4).collect()] == [4, 6, 8] and p.names() == ["above", "double"]
    with pytest.raises(ValueError):
        p.register("double", print)
    p.register("double", lambda df: None, replace=True)
    with pytest.raises(TypeError):
        p.apply(spark.range(1), "double")
    with pytest.raises(KeyError):
        p.apply(spark.range(1), "unknown")


def test_hooks_see_each_commit_of_a_stream_once(spark, tmp_path):
    rows = spark.createDataFrame([(f"h{k}", f"feat: {k}" if k % 3 else "search") for k in range(30)], "hash string, message string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    hooks, found, order = replay.Hooks(), str(tmp_path / "index"), []
    hooks.register("onCommit", lambda df: order.append("index"))
    hooks.register("onCommit", lambda df: df.select("hash").write.mode("append").parquet(found))
    hooks.register("onDiff", lambda df: order.append("never"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    route = {"onCommit": F.col("message").startswith("feat"), "onDiff": F.col("message") == "no such"}
    for _ in range(2):  # the second run has nothing new
        replay.dispatch(stream, hooks, route).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["hash"] for r in spark.read.parquet(found).collect()) == sorted(f"h{k}" for k in range(30) if k % 3)
    assert order == ["index"] * 3


def test_index_hook_appends_entries(spark, tmp_path):
    o = spark.createDataFrame([(1, 7, "O", "2-HIGH")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").withColumn("o_orderdate", F.lit("2026-01-02 03:04:05").cast("timestamp_ntz"))
    f = spark.createDataFrame([(1, 5, 1, 15.0, "A")], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string")
    hooks = replay.Hooks()
    hooks.register("onCommit", records.index_on_commit(str(tmp_path / "index")))
    for _ in range(2):
        hooks.trigger("onCommit", records.records(o, f))
    assert [r["message"] for r in spark.read.parquet(str(tmp_path / "index")).collect()] == ["feat: update clause 1"] * 2


def test_sql_functions_equal_columns(spark):
    sql.register(spark)
    rows = spark.createDataFrame([("feat: add clause",), ("feat:none",), ("other: x",), ("fix: " + "x" * 60,), ("",), (None,), ("Terms & Fees (2)",)], "m string")
    got = rows.selectExpr("message_type(m) AS t", "message_is_valid(m) AS v", "heading_slug(m) AS s").collect()
    assert got == rows.select(text.message_type(F.col("m")).alias("t"), text.message_is_valid(F.col("m")).alias("v"), text.slug(F.col("m")).alias("s")).collect()
    assert [r["v"] for r in got] == [True, False, False, False, False, False, False]
