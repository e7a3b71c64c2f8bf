"""Hard negatives against brute force, and the brackets against true scores."""

import math
import random

import numpy as np
import pytest

from folioweave.llm import pivot_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, score string"


def brute(rows, relabel=7, k=5):
    usable = {(i, (l + 1) % 10 if relabel and i % relabel == 0 else l, tuple(math.floor(256 * x) for x in v)) for i, v, l in rows if None not in (i, v, l) and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for anchor, label, q in usable:
        if anchor % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(q, v, strict=True)), i, l) for i, l, v in usable if len(v) == len(q)]
        for s, positive, _ in sorted(x for x in scored if x[2] == label and x[1] != anchor)[:k]:
            fits = sorted((t, i) for t, i, l in scored if l != label and 80 * -s <= 100 * -t <= 100 * -s)[:k]
            out |= {(anchor, positive, n + 1, i, -s, -t) for n, (t, i) in enumerate(fits)}
    return sorted(out)


def found(spark, rows, **how):
    vectors = spark.createDataFrame([(i, v, l, "x", "y") for i, v, l in rows], SCHEMA)
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r) for r in pivot_negatives.hard_negatives(vectors, relabel_every=7, **how).select(*names).collect())


def corpus():
    r = random.Random(5)
    middle = [[r.gauss(0, 0.3) for _ in range(6)] for _ in range(10)]
    rows = [(i, [x + r.gauss(0, 0.1) for x in middle[i % 4 if i % 3 else 2]], r.randrange(10) if i % 5 else 2) for i in range(400)]
    rows += [(1000 + i, rows[0][1], 2 + i % 2) for i in range(60)] + rows[:7]
    rows += [(i, [round(x, 1) for x in middle[i % 3]], i % 4) for i in range(2000, 2150)]
    rows += [(None, middle[0], 1), (3000, None, 1), (3001, middle[0], None), (3002, [1.0, None] * 3, 1), (3003, [float("nan")] * 6, 1), (3100, [float("-inf")] * 6, 1)]
    rows += [(4000, [1.0, 2.0], 1), (4001, [1.0, 1.0], 2), (4002, [2.0, 2.0], 1), (5000, [], 3), (5001, [], 4), (5002, [], 3), (6000, [0.0] * 6, 1), (6100, [-x for x in middle[0]], 0)]
    return rows


@pytest.mark.parametrize("how", [{}, {"block": 16, "anchors": 3, "pivot_count": 4, "sample": 40}, {"block": 50, "pivot_count": 1, "sample": 1}])
def test_negatives_equal_brute_force(spark, how):
    rows = corpus()
    assert found(spark, rows, **how) == brute(rows)


def test_large_values_are_exact(spark):
    rows = [(100, [3e5, 1e5], 0), (1, [3e5, 1e5 + 1], 0), (2, [3e5, 1e5 - 1], 1), (3, [3e5 - 1, 1e5], 1), (4, [2.5e5, 1e5], 2), (5, [-1e5, 2e5], 0), (8, [1e8, 0.0], 0), (9, [0.9e8, 1.0], 4)]
    assert found(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="exceeds a long"):
        found(spark, [(100, [1e9] * 200, 0), (1, [1e9] * 200, 0)])


def test_no_anchor_no_positive_no_row(spark):
    assert found(spark, []) == [] and found(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == [] and found(spark, [(100, [1.0], 0), (2, [1.0], 1)]) == []
    assert found(spark, [(100, [1.0], 0), (1, [-1.0], 0), (2, [1.0], 1)]) == []


def test_brackets_hold_every_score():
    r = np.random.default_rng(2)
    for d, scale in ((1, 5), (8, 300), (64, 10**6)):
        x, q = r.integers(-scale, scale, (200, d)).astype(float), r.integers(-scale, scale, (50, d)).astype(float)
        q[0], x[0] = 0, 0
        sphere = pivot_negatives.Sphere(float(np.sqrt((x * x).sum(1).max())) * (1 + 2.0**-30), {d: x[:9]})
        low, high = sphere.brackets(*sphere.asked(q), sphere.stored(x), d)
        true = q @ x.T
        assert (low <= true).all() and (true <= high).all()
        assert (high - low).mean() < (np.sqrt((q * q).sum(1)).mean() * sphere.radius) * 2
