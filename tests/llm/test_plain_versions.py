"""Weak supervision, mixing, secret candidates and hot SimHash buckets against plain versions."""

import math
import random
import re
from collections import Counter

from folioweave.llm import mixing, quality_rules, secret_scan, simhash_dedup


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, 1, 0.5, "x", 2) for i, t, s in rows], "doc_id long, text string, source string, n_words int, probability double, words string, place int")


def groups(nodes, edges):
    root = {x: x for x in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return {x: top(x) for x in nodes}


def test_large_buckets_link_what_all_pairs_link(spark):
    r = random.Random(3)
    centres = [r.getrandbits(64) for _ in range(3)]
    prints = {0, *centres}
    for c in centres:
        for _ in range(20):
            x = c
            for k in r.sample(range(64), r.choice([1, 3, 5, 8])):
                x ^= 1 << k
            prints.add(x)
    prints = sorted(simhash_dedup.signed(x) for x in prints)
    near = [(a, b) for a in prints for b in prints if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 4]
    rows = spark.createDataFrame([(x,) for x in prints], "fp long")
    want = groups(prints, near)
    assert 4 < len(set(want.values())) < len(prints)
    for most in (3, 256):
        assert groups(prints, [tuple(x) for x in simhash_dedup.linked(rows, max_bucket=most).collect()]) == want


def posteriors(votes, prior=0.85, strength=20.0):
    """Expectation-maximisation document by document."""
    rules = range(len(quality_rules.RULES))
    start = [row.tolist() for row in quality_rules.START]
    table, share, after = [[list(start[y]) for _ in rules] for y in (0, 1)], prior, [0.0] * len(votes)
    for _ in range(500):
        before, after = after, []
        for v in votes:
            bad, good = ((math.prod(table[y][k][v[k]] for k in rules)) * (share if y else 1 - share) for y in (0, 1))
            after.append(good / (good + bad))
        if max(abs(a - b) for a, b in zip(after, before, strict=True)) < 1e-9:
            break
        for y in (0, 1):
            for k in rules:
                seen = [strength * x for x in start[y]]
                for v, p in zip(votes, after, strict=True):
                    seen[v[k]] += p if y else 1 - p
                table[y][k] = [x / sum(seen) for x in seen]
        for k in rules:
            table[0][k][quality_rules.BAD] = max(table[0][k][quality_rules.BAD], table[1][k][quality_rules.BAD])
            table[1][k][quality_rules.GOOD] = max(table[0][k][quality_rules.GOOD], table[1][k][quality_rules.GOOD])
        share = min(max((sum(after) + prior * strength) / (len(after) + strength), 0.5), 0.99)
    return after


def test_quality_verdicts_are_those_of_a_plain_estimation(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    votes = {i: [quality_rules.measure(t)[-1] // 3**k % 3 for k in range(len(quality_rules.RULES))] for i, t in texts.items()}
    want = dict(zip(votes, posteriors(list(votes.values())), strict=True))
    got = quality_rules.quality_report(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert abs(r["probability"] - want[r["doc_id"]]) < 1e-5
        assert r["kept"] == (not r["base_failed"] and want[r["doc_id"]] >= 0.5)


def test_quality_of_odd_tables(spark):
    rows = [(1, None, "a"), (1, None, "a"), (None, "", None), (2, "word " * 50_000, "a"), (3, "The cat sat on a mat, and it was glad. " * 3 + " ".join(f"Then came w{k}." for k in range(60)), "a")]
    got = quality_rules.quality_report(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["base_failed"]) for r in got) == [(0, 0, True), (1, 0, True), (1, 0, True), (2, 50_000, True), (3, 210, False)]
    assert quality_rules.quality_report(frame(spark, [])).count() == 0
    kept = quality_rules.quality_filter(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns and {r["doc_id"] for r in kept.collect()} <= {3}


def test_readings_are_those_of_sorted_permutations(spark):
    r = random.Random(5)
    rows = [(k, "w " * r.randrange(1, 40), "hot" if k % 3 else f"s{k % 5}") for k in range(500)] + [(900, "", "bare"), (901, None, "bare"), (902, "a b", None)]
    docs = frame(spark, rows)
    place = {x["doc_id"]: x["p"] for x in docs.select("doc_id", mixing.place_of(docs["doc_id"], 11).alias("p")).collect()}
    plan = {x["source"]: x for x in mixing.mixture_plan(docs, max_repeats=1.5).collect()}
    got = Counter(x["doc_id"] for x in mixing.mix(docs, max_repeats=1.5).collect())
    for source in {s for _, _, s in rows}:
        own = sorted((place[i], i, len((t or "").split())) for i, t, s in rows if s == source)
        tokens = sum(n for _, _, n in own)
        if not tokens:
            assert source not in plan and all(got[i] == 1 for _, i, _ in own)
            continue
        full, rest = divmod(plan[source]["wanted"], tokens)
        for _, i, n in own:
            rest -= n
            assert got[i] == full + (rest >= 0), (source, i)


def test_readings_without_ids_keep_the_budget_and_blocks_are_permuted(spark):
    docs = frame(spark, [(None, f"w{k} " * 10, "hot") for k in range(300)] + [(k, "w " * 10, "rare") for k in range(30)])
    got = mixing.mix(docs, max_repeats=1.5, block_tokens=600).collect()
    n = Counter(x["source"] for x in got)
    assert n["hot"] == 300 and 44 <= n["rare"] <= 45
    for block in {x["block"] for x in got}:
        turns = [(x["turn"], x["source"]) for x in got if x["block"] == block]
        assert len(set(turns)) == len(turns)
    order = [x["source"] for x in sorted(got, key=lambda x: (x["block"], x["turn"]))]
    assert sum(a != b for a, b in zip(order, order[1:], strict=False)) > 30


def test_candidates_are_the_long_runs_of_words(spark):
    r = random.Random(6)
    words = ["short", "a" * 15, "b" * 16, "0123456789abcdef0123", '"quoted/path_of+signs=="', "x" * 20 + "," + "y" * 17, "über" + "z" * 16, "." * 20, "q" * 5_000]
    rows = [(k, " ".join(r.choices(words, k=30)), "a") for k in range(40)] + [(0, "b" * 16, None), (None, "b" * 16, "a"), (77, None, "a"), (78, "", "a")]
    want = Counter()
    for i, t, _ in rows:
        for k, w in enumerate(re.findall(r"[^\x20\x09-\x0D]+", t or "")):
            for run in re.findall(r"[A-Za-z0-9_+/=.-]*[A-Za-z0-9_+/=-]", w):
                if len(run) >= 16:
                    want[i, k, run] += 1
    assert Counter((x["doc_id"], x["word_at"], x["found"]) for x in secret_scan.candidates(frame(spark, rows)).collect()) == want
