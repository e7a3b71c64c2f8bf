"""Exact quantiles of groups of any size: mergeable sketches bracket them, and only what lies in the brackets is sorted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

#: Items that a sketch keeps at a level, and how far the brackets reach: the rank error of such a sketch is under 1 % (99 times of 100), and a bracket that misses is widened.
SKETCH, REACH = 400, 0.01


def exact_quantiles(df: DataFrame, group: str | None, value: str, shares: dict[str, float], reach: float = REACH) -> DataFrame:
    """group, then a column for each of ``shares``: its quantile, between two values in proportion, and n, the number of values.

    Nulls and NaN don't count; a group of none but these has no row. Sketches are merged from all
    tasks; the second pass counts what lies below a bracket and each value in it, so no task holds
    the values of a group, and the result doesn't depend on the sketches.
    """
    x = df.select((F.col(group) if group else F.lit(0)).alias("g"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    sketches = cut(x.groupBy("g").agg(F.kll_sketch_agg_double("v", SKETCH).alias("sketch"), F.count("*").alias("n")))
    place = F.col("q") * (F.col("n") - 1)
    asked = sketches.select("g", "sketch", "n", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in shares.items()])).alias("s")).select("g", "sketch", "n", "s.*")
    asked = asked.select("g", "sketch", "n", "name", "q", F.floor(place).alias("below"), F.ceil(place).alias("above"), (place - F.floor(place)).alias("part"))
    done = []
    while True:
        # A sketch is asked for literal ranks only. Beyond its ends a bracket is open.
        at = lambda q, out: F.kll_sketch_get_quantile_double("sketch", F.lit(q)) if 0 <= q <= 1 else F.lit(out)
        end = lambda step, out: F.coalesce(*[F.when(F.col("name") == name, at(q + step, out)) for name, q in shares.items()])  # noqa: E731, B023
        brackets = asked.select("g", "name", end(-reach, float("-inf")).alias("lo"), end(reach, float("inf")).alias("hi"))
        near = x.join(brackets.withColumnRenamed("g", "own"), F.col("g").eqNullSafe(F.col("own"))).drop("own")
        counts = near.where("v <= hi").groupBy("g", "name", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count("*").alias("k"))
        ranked = counts.withColumn("until", F.sum("k").over(Window.partitionBy("g", "name").orderBy(F.asc_nulls_first("v"))))
        met = ranked.join(asked.select(F.col("g").alias("own"), F.col("name").alias("asked"), "below", "above"), F.col("g").eqNullSafe(F.col("own")) & (F.col("name") == F.col("asked")))
        holds = lambda r: F.max(F.when((F.col("until") > F.col(r)) & (F.col("until") - F.col("k") <= F.col(r)), F.col("v")))
        found = cut(met.groupBy("g", "name").agg(holds("below").alias("low"), holds("above").alias("high")))
        both = asked.join(found.withColumnsRenamed({"g": "own", "name": "met"}), F.col("g").eqNullSafe(F.col("own")) & (F.col("name") == F.col("met")), "left")
        settled = F.col("low").isNotNull() & F.col("high").isNotNull()
        done.append(both.where(settled).select("g", "n", "name", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("x")))
        asked = cut(both.where(~settled).select(*asked.columns))
        if asked.isEmpty():
            break
        reach *= 8
    every = reduce(DataFrame.unionByName, done).groupBy("g", "n").agg(*[F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in shares])
    return every.select(*([F.col("g").alias(group)] if group else []), *shares, "n")
