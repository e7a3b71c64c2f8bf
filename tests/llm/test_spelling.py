"""Spelling variants against brute force, and the prefix filter's keys against every near pair."""

import random
import re
import zlib
from collections import Counter

import pytest

from folioweave.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, form string"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, worn=199, least=5, ratio=5):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if worn and h % worn == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least}
    close = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, others in close.items():
        if others and n[best := min(others, key=lambda x: (-n[x], x))] >= ratio * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(close[w]), n[form[w]] if w in form else None))
    return sorted(out)


def found(spark, rows, worn=199):
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    return sorted(tuple(r) for r in spelling.variants(docs, worn=worn).select("word", "form", "root", "n", "n_near", "form_n").collect())


def edited(r, w, letters):
    k = r.randrange(len(w) + 1)
    return r.choice((w[:k] + r.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k + 1 :]))


@pytest.mark.parametrize("letters", ["ab", "abcdeß", "etaoinÀé÷"])
def test_variants_equal_brute_force(spark, letters):
    r = random.Random(len(letters))
    base = ["".join(r.choice(letters) for _ in range(r.randrange(5, 12))) for _ in range(60)]
    words = base + [edited(r, r.choice(base), letters) for _ in range(120)]
    words += [edited(r, r.choice(words), letters) for _ in range(60)]
    rows = [(k, " ".join(r.choice(words[: 1 + int(len(words) * r.random() ** 3)]) for _ in range(200)).replace("a", r.choice("aaA"))) for k in range(60)]
    rows += [(None, " ".join(words)), (3, None), (4, ""), (5, rows[0][1]), (5, rows[0][1]), (99, "x" * 30_000 + " " + "abcdef" * 3000), (100, "İstanbul Straße Straße")]
    got = found(spark, rows)
    assert got == brute(rows)
    assert any(x[1] for x in got)


def test_worn_words_come_home(spark):
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(20)]
    rows = [(k, " ".join(words)) for k in range(3000)]
    got = found(spark, rows)
    assert got == brute(rows)
    assert any(x[1] for x in got) and {x[2] for x in got} == set(words)
    assert found(spark, rows, worn=None) == brute(rows, worn=None)


def test_chains_end_at_the_root(spark):
    steps = ["abcdef", "abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"]
    rows = [(k, " ".join([w] * 5 ** (k + 1))) for k, w in enumerate(steps)]
    assert {x[0]: x[2] for x in found(spark, rows, worn=None)} == dict.fromkeys(steps, "abcdefghij")
    assert found(spark, rows, worn=None) == brute(rows, worn=None)


def test_every_near_pair_shares_a_key():
    r = random.Random(3)
    for _ in range(4000):
        letters = r.choice(("ab", "abc", "abcdefgh"))
        a = "".join(r.choice(letters) for _ in range(r.randrange(6, 12)))
        b = edited(r, a, letters)
        if len(b) < 6 or a == b:
            continue
        grams = sorted({w[i : i + 2] for w in (a, b) for i in range(len(w) - 1)})
        r.shuffle(grams)
        ranks = {g: k for k, g in enumerate(grams)}
        assert spelling.keys(a, ranks) & spelling.keys(b, ranks), (a, b)


def test_no_words(spark):
    assert found(spark, []) == [] and found(spark, [(1, None), (2, "short"), (3, "abcdef " * 4)]) == []
