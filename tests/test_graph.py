"""Merge bases by a walk from both heads, against the closure of small histories, and on a long one."""

import random
from collections import deque

import pytest

from folioweave.operators import records


def distances(up, start):
    seen, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        for y in up.get(x, ()):
            if y not in seen:
                seen[y] = seen[x] + 1
                queue.append(y)
    return seen


def brute(edges, heads):
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)
    out = set()
    for a, b in heads:
        x, y = distances(up, a), distances(up, b)
        common = sorted((x[n] + y[n], n) for n in x if n in y)
        out.add((a, b, *((common[0][1], common[0][0]) if common else (None, None))))
    return out


def found(spark, edges, heads):
    got = records.merge_bases(spark.createDataFrame(heads, "a long, b long"), spark.createDataFrame(edges, "child long, parent long"))
    return {tuple(r) for r in got.select("a", "b", "base", "steps").collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_bases_equal_the_closure(spark, seed):
    r = random.Random(seed)
    edges, heads, first = [], [], 0
    for _ in range(25):  # histories apart from each other: chains, branches, merges
        n = r.randrange(2, 40)
        for k in range(1, n):
            last = max(0, k - r.choice((1, 1, 1, 1, 2, 5)))
            edges += [(first + k, first + last)] + ([(first + k, first + r.randrange(k))] if r.random() < 0.15 else [])
        heads += [(first + r.randrange(n), first + r.randrange(n)) for _ in range(4)]
        first += n
    heads += [(0, first - 1), (5, 5)]
    assert found(spark, edges + edges[:9], heads + heads[:2]) == brute(edges, heads)


def test_a_long_history_takes_few_rounds(spark):
    n = 2_000
    edges = [(k, k - 1) for k in range(1, n)] + [(n, n // 2)] + [(k, k - 1) for k in range(n + 1, 2 * n)]
    assert found(spark, edges, [(n - 1, 2 * n - 1), (n - 1, 3)]) == {(n - 1, 2 * n - 1, n // 2, (n - 1 - n // 2) + n), (n - 1, 3, 3, n - 4)}


def test_no_history(spark):
    assert found(spark, [], []) == set() and found(spark, [], [(1, 2), (3, 3)]) == {(1, 2, None, None), (3, 3, 3, 0)}


def written(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_ancestry_equals_the_closure_and_shuffles_little(spark):
    edges = [(k, k - 1) for k in range(1, 400)] + [(k, k - 37) for k in range(60, 400, 11)] + [(7, 5), (900, 901), (901, 900)]
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)
    want = {(c, a, d) for c in up for a, d in distances(up, c).items() if a != c} | {(900, 900, 2), (901, 901, 2)}
    frame, before = spark.createDataFrame(edges + edges[:5], "child long, parent long"), written(spark)
    got = [tuple(x) for x in records.ancestry(frame).collect()]
    assert len(got) == len(want) and set(got) == want
    assert written(spark) - before < 80 * len(want)  # bytes a pair
    assert records.ancestry(frame.limit(0)).count() == 0
