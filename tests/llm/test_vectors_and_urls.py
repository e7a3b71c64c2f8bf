"""Exact top-k and the URL filter against brute force, and the quality classifier on held-out rows."""

import math
import random
import zlib

import numpy as np
import pytest

from folioweave.llm import fm_quality, url_filter, va_topk


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0.5) for i, v in rows], "vec_id long, embedding array<double>, score int, rank double")


def brute(rows, k=10):
    usable = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted({i for i, _ in usable if i % 100 == 0}):
        scored = [(-sum(a * b for a, b in zip(x, y, strict=True)), j) for i, x in usable if i == q for j, y in usable if j != q and len(x) == len(y)]
        out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scored)[:k])]
    return out


def found(spark, rows, **how):
    return sorted(tuple(r) for r in va_topk.top_k(vectors(spark, rows), **how).select("query_id", "rank", "vec_id", "score").collect())


def test_topk_equals_brute_force(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(240)]
    rows += [(300 + i, rows[0][1]) for i in range(30)] + rows[:5] + [(None, [1.0] * 6), (7, None), (8, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (9, [float("nan")] * 6), (400, [float("inf")] * 6)]
    rows += [(500, [1.0, 2.0]), (501, [3.0, 1.0]), (600, []), (601, []), (100, [0.5] * 6)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, block=16, query_block=2) == brute(rows)


def test_topk_of_large_values_is_not_clipped(spark):
    rows = [(0, [1.0, 0.0]), (1, [3000.0, 0.0]), (2, [2000.0, 0.0]), (3, [1e9, 5.0]), (100, [-1e3, 1e3])]
    assert found(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="exceeds a long"):
        found(spark, [(0, [1e30]), (1, [1.0])])


def test_topk_of_nothing(spark):
    assert found(spark, []) == [] and found(spark, [(1, [1.0])]) == [] and found(spark, [(0, [1.0])]) == []


def plain_verdict(url, listed):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), v, h + p) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[2], max(fits)[1]
    labels = host.split(".")
    hosts = {".".join(labels[k:]) for k in range(len(labels))}
    parts = (path or "/").split("/")
    paths = {path or "/"} | {"/".join(parts[:k]) + "/" for k in range(1, len(parts))}
    return host, path, None, "block" if any((h + p) in listed for h in hosts for p in paths) else "allow"


def test_urls_equal_brute_force(spark):
    r = random.Random(2)
    tops, words = ("com", "org", "net"), ("a", "b", "shop", "de", "fr", "x1", "es")
    listed = {f"{r.choice(words)}.{r.choice(words)}.{r.choice(tops)}/" + "".join(f"{r.choice(words)}/" for _ in range(r.randrange(4))) for _ in range(60)}
    listed |= {f"s{k}.{t}/" for k in range(3000) for t in tops}
    url = lambda: f"http://{'.'.join(r.choice(words) for _ in range(r.randint(1, 6)))}.{r.choice(tops)}/" + "/".join(r.choice(words) for _ in range(r.randrange(6))) + r.choice(("", "?q=1", "#z", "/"))
    urls = [url() for _ in range(1500)] + [f"https://m.s{k}.NET/q" for k in range(2900, 3100)] + [None, "", "no scheme", "http://", "HTTP://A.ORG", "http://x.com/" + "d/" * 3000] + [url()] * 3
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, verdict string, rule string")
    frame = spark.createDataFrame([(f"https://{x}",) for x in sorted(listed)], "url string")
    got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in url_filter.judge_urls(pages, frame).collect()}
    assert got == {k: plain_verdict(u, listed) for k, u in enumerate(urls)}
    assert {"allow", "block"} <= {x[3] for x in got.values() if x[2] is None}
    assert url_filter.judge_urls(pages.where("false"), frame).count() == 0


def test_the_join_removes_what_the_bloom_filter_lets_through(spark):
    keys = spark.range(4000).selectExpr("concat('s', id, '.net/') as key")
    rows, blocks = url_filter.bloom_blocks(keys, 4000)
    others = spark.range(200_000).selectExpr("concat('t', id, '.net/') as key").withColumn("block", url_filter._block(url_filter.F.col("key"), blocks))
    for probe, least, most in ((others, 1, 20_000), (keys.withColumn("block", url_filter._block(url_filter.F.col("key"), blocks)), 4000, 4000)):
        met = probe.join(rows, "block")
        for k, b in enumerate(url_filter._bits(url_filter.F.col("key"))):
            met = met.where(url_filter.F.col(f"w{k}").bitwiseAND(b) == b)
        assert least <= met.count() <= most
    pages = spark.range(20_000).selectExpr("id as page_id", "concat('http://t', id, '.net/') as url")
    listed = keys.selectExpr("concat('http://', key) as url")
    assert url_filter.judge_urls(pages, listed).where("verdict = 'block'").count() == 0


def test_quality_is_learned_and_held_out(spark):
    r = random.Random(3)
    good, bad = "the clause shall apply when notice is given".split(), "buy $$$ now *** click ### win %%% FREE".split()
    rows = [(k, " ".join(r.choice(good if k % 3 else bad) for _ in range(60)) + ("." if k % 3 else ""), "en", "s", 100) for k in range(500)]
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (None, "text", "en", "s", 4), (3, rows[3][1], "en", "s", 100), (902, "word " * 40_000, "en", "s", 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", fm_quality.F.lit("clash"))
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(500)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = fm_quality.score_quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.7) for x in got)
    assert all(x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in got)
    held = [x for x in got if x["held_out"] and x["doc_id"] < 500]
    assert len(held) > 80 and np.mean([x["predicted"] == (x["doc_id"] % 3 > 0) for x in held]) >= 0.97
    again = {x["doc_id"]: x["score"] for x in fm_quality.score_quality(docs, labels.where("crc32(string(doc_id)) % 4 <> 2")).collect()}
    assert all(abs(again[x["doc_id"]] - x["score"]) < 0.05 for x in held)
    assert all(x["score"] == 0.5 for x in fm_quality.score_quality(docs, labels.where("false")).collect())
    assert fm_quality.score_quality(docs.where("false"), labels).count() == 0


def test_two_runs_train_the_same_machine(spark):
    rows = [(k, " ".join(f"w{(k * j) % 50}" for j in range(30)), 100) for k in range(400)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    turned = spark.createDataFrame(rows[::-1], "doc_id long, text string, n_chars long").repartition(5)
    a, b = fm_quality.train(docs, labels), fm_quality.train(turned, labels)
    assert a.w0 == b.w0 and np.array_equal(a.w, b.w) and np.array_equal(a.v, b.v)


def test_the_machine_equals_all_pairs():
    r = np.random.default_rng(5)
    m = fm_quality.Machine(0.3, r.normal(0, 1, fm_quality.FEATURES).astype(np.float32), r.normal(0, 0.3, (fm_quality.FEATURES, fm_quality.FACTORS)).astype(np.float32))
    at, x = fm_quality.features("some words, some more words here", 33)
    plain = m.w0 + (m.w[at] * x).sum() + sum(float(m.v[at[i]] @ m.v[at[j]]) * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert m.probability(at, x, np.array([0]))[0] == pytest.approx(1 / (1 + math.exp(-plain)), abs=1e-4)


def test_parents_of_one_label_are_looked_up(spark):
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(("http://x.xxx/p", "http://xxx/", "http://a.b.xxx", "http://x.xxy/p", "http://xxx.com/"))], "page_id long, url string, verdict string, rule string")
    verdicts = lambda *listed: [x["verdict"] for x in url_filter.judge_urls(pages, spark.createDataFrame([(u,) for u in listed], "url string")).orderBy("page_id").collect()]
    assert verdicts("http://xxx/") == ["block", "block", "block", "allow", "allow"]
    assert verdicts("http://xxx/", "http://n.m.b.xxx/") == ["block", "block", "block", "allow", "allow"]
    assert verdicts("http://b.xxx/", "http://x.xxx/p") == ["block", "allow", "block", "allow", "allow"]
