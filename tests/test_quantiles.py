"""Exact quantiles against sorted values, and numbers of any depth against counters stepped by hand."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioweave.operators import documents, quantiles

SHARES = {"least": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "most": 1.0}


@pytest.mark.parametrize("reach", [0.01, 0.000001])
def test_quantiles_equal_sorted_values(spark, reach):
    r = random.Random(3)
    rows = [(g, v) for g, n in (("a", 5000), ("b", 1), (None, 2), ("c", 300)) for v in [r.choice([r.gauss(0, 1), 7.0, 7.0, -1e300]) for _ in range(n)]]
    rows += [("a", None), ("d", None), ("c", float("nan"))]
    got = {x["g"]: x for x in quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", SHARES, reach).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, x in got.items():
        values = [v for h, v in rows if h == g and v is not None and v == v]
        assert x["n"] == len(values)
        assert [x[s] for s in SHARES] == pytest.approx([float(np.quantile(values, q)) for q in SHARES.values()], rel=1e-12)


def test_quantiles_of_all_and_of_none(spark):
    frame = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    assert quantiles.exact_quantiles(frame, None, "v", {"p50": 0.5, "p25": 0.25}).collect()[0][:2] == (500.0, 250.0)
    assert quantiles.exact_quantiles(frame.where("false"), None, "v", {"p50": 0.5}).collect() == []


def test_numbers_reset_below_a_higher_heading(spark):
    r, rows, want = random.Random(2), [], set()
    for d in range(20):
        counts = [0] * 9
        for pos in range(r.randrange(40)):
            level = r.choice([None, 1, 2, 2, 3, 3, 4, 9])
            rows.append((d, pos, level))
            if level:
                counts[level - 1] += 1
                counts[level:] = [0] * (9 - level)
                want.add((d, pos, ".".join(map(str, counts[:level]))))
    got = documents.deep_numbers(spark.createDataFrame(rows, "d int, pos int, level int"), "d")
    assert {(x["d"], x["pos"], x["number"]) for x in got.collect()} == want
