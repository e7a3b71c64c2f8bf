"""License scan, mixing, secret scan, packing, quality rules, SimHash and URL filter on small fixtures."""

import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from folioweave.llm import license_scan, mixing, packing, quality_rules, secret_scan, simhash_dedup, url_filter

SECRET = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
ODD = [
    (1, "Released under the MIT License. mit license", "a", "x"), (2, None, "a", "x"), (3, "", None, "x"), (None, f'the token = "{SECRET}" is here', "a", "x"),
    (5, "GNU General Public License and İ Apache License", "b", "x"), (5, "GNU General Public License and İ Apache License", "b", "x"), (7, "word " * 30_000, "b", "x"),
]


def frame(spark, rows, extra="weight"):
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {extra} string")


def test_license_places(spark):
    found = license_scan.scan(frame(spark, ODD)).collect()
    got = {x["doc_id"]: (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) for x in found}
    assert len(found) == len(ODD)
    assert got[1] == (7, 2, 3, 5, "mit")
    assert got[2] == got[3] == (0, 0, None, None, "")
    assert got[5] == (8, 2, 1, 6, "apache,gpl")
    assert got[7][:2] == (30_000, 0)
    assert license_scan.scan(frame(spark, [])).count() == 0


def test_license_templates_need_their_key_phrases(spark):
    text = license_scan.TEMPLATES[3].text
    rows = [(1, "x " + text.upper(), "", ""), (2, text.replace("charge", "cost"), "", ""), (3, "all rights reserved", "", "")]
    assert {x["doc_id"]: x["labels"] for x in license_scan.scan(frame(spark, rows)).collect()} == {1: "mit", 2: "", 3: "proprietary"}


def test_mixing_meets_its_targets(spark):
    rows = [(k, "w " * (1 + k % 5), "hot" if k % 3 else f"s{k % 4}", "x") for k in range(600)]
    docs = frame(spark, rows)
    tokens = Counter()
    for _, t, s, _ in rows:
        tokens[s] += len(t.split())
    got = mixing.mix(docs, max_repeats=1.5).collect()
    weights = {x["source"]: x["weight"] for x in got}
    ratio = [weights[s] / tokens[s] for s in tokens]
    assert sum(weights.values()) == pytest.approx(1) and max(ratio) / min(ratio) == pytest.approx(1.5, abs=1e-6)
    assert {x["doc_id"] for x in got} == set(range(600))
    taken = Counter()
    for x in got:
        taken[x["source"]] += x["n_tokens"]
    total = max(tokens[s] / weights[s] for s in tokens)
    for s in tokens:
        assert total * weights[s] - 6 <= taken[s] <= total * weights[s] + 1
    got = mixing.mix(docs, target_entropy=1.4, budget=400).collect()
    w = {x["source"]: x["weight"] for x in got}
    assert -sum(x * math.log(x) for x in w.values()) == pytest.approx(1.4, abs=1e-5)
    assert 360 <= sum(x["n_tokens"] for x in got) <= 401


def test_mixing_edges(spark):
    assert Counter(x["doc_id"] for x in mixing.mixed_documents(frame(spark, ODD)).collect())[3] == 1
    assert mixing.mixed_documents(frame(spark, ODD)).columns == ["doc_id", "text", "source", "weight"]
    assert mixing.mix(frame(spark, [])).count() == 0


def test_secrets_are_found_and_hidden(spark):
    rows = [*ODD, (8, "commit 9fceb02d0ae598e95dc970b74767f19372d61af8 and thnterioningheshthewh or your_api_key_here", "docs", "x")]
    found = secret_scan.scan(frame(spark, rows)).collect()
    assert [x["doc_id"] for x in found if x["is_secret"]] == [None]
    assert {x["doc_id"] for x in found} == {None, 8}
    hidden = {x["doc_id"]: x["text"] for x in secret_scan.redacted(frame(spark, [(9, f'token = "{SECRET}"', "a", "x")], "bad")).collect()}
    assert hidden == {9: 'token = "[SECRET]"'}
    assert secret_scan.scan(frame(spark, [])).count() == 0


def test_forest_on_held_out_findings(spark):
    findings = secret_scan.labelled_findings(spark).withColumn("fold", secret_scan.F.crc32("found") % 4)
    model = secret_scan.train(findings.where("fold <> 2"))
    rows = model.transform(secret_scan.featured(findings.where("fold = 2"))).select("label", "prediction").collect()
    assert sum(x["label"] == x["prediction"] for x in rows) >= 0.93 * len(rows)


def test_packing_is_a_round_trip(spark):
    texts = ["", None, "a b", "it's  fine\n\n x", "<|endoftext|> ß ", "long words here " * 900, "ab" * 3000, "a b"]
    got = packing.packed_sequences(frame(spark, [(k, t, "s", "x") for k, t in enumerate(texts)])).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((x for x in got if x["doc_id"] == k), key=lambda x: x["piece"])
        assert [x["start"] for x in own] == [sum(y["length"] for y in own[:i]) for i in range(len(own))] and sum(x["length"] for x in own) == len(ids)
        assert all(zlib.crc32(ids[x["start"] : x["start"] + x["length"]].tobytes()) == x["ids_crc32"] for x in own)
        assert len(own) == 1 or len(ids) > 2048
    by = {}
    for x in got:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for spans in by.values():
        spans.sort()
        assert all(o == sum(n for _, n in spans[:i]) for i, (o, _) in enumerate(spans)) and sum(n for _, n in spans) <= 2048


def test_quality_counts(spark):
    texts = ["", None, "a b c a b c\na b c a b c\n\n x", "# * <> word|word " * 20, "one two three four. " * 40]
    got = {x["doc_id"]: x for x in quality_rules.quality_report(frame(spark, [(k, t, "s", "x") for k, t in enumerate(texts)])).collect()}
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        assert (got[k]["n_words"], got[k]["word_chars"], got[k]["n_symbols"], got[k]["n_dup_lines"], got[k]["n_repeat_words"]) == want
        assert got[k]["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert quality_rules.quality_filter(frame(spark, ODD, "votes")).columns == ["doc_id", "text", "source", "votes"]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[k : k + 4]).encode(), seed=42).intdigest() for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark):
    base = " ".join(f"w{k}" for k in range(200))
    texts = [base, base + " end", base.replace("w7 ", "v7 "), "", None, "other text", "x y z w v"] + [base.replace(f"w{k} ", "q ") for k in range(10, 40)]
    got = {x["doc_id"]: x for x in simhash_dedup.near_duplicate_components(frame(spark, [(k, t, "s", "x") for k, t in enumerate(texts)])).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in combinations(range(len(texts)), 2):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                root[a] = root[b] = min(root[a], root[b])
    assert [got[k]["fp"] % (1 << 64) for k in range(len(texts))] == prints
    assert [got[k]["component_id"] for k in range(len(texts))] == root


def test_url_rules(spark):
    urls = ["http://a.Org/x", "http://www.example.org/es/1", "http://example.org/en/12", None, "no scheme", "http://x.com/de/a?b", "http://x.com/fr/", "http://ads-track.example.net/p"]
    got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filter.default_list(spark)).collect()}
    assert got[0] == ("a.org", "/x", "org/", "allow")
    assert got[1] == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3] == got[4] == ("", "", None, "allow")
    assert got[5][2:] == ("com/de/", "block") and got[6][2:] == ("com/fr/", "allow")
    assert got[7] == ("ads-track.example.net", "/p", None, "block")


def test_url_keys_reach_every_listed_depth(spark):
    listed = spark.createDataFrame([("http://ads-track.example.com/",), ("http://h.net/a/b/c/d/",), ("http://a.b.c.d.e.f.g.deep.com/q/",)], "url string")
    urls = {
        "http://a.b.c.d.e.ads-track.example.com/p": "block", "http://ads-track.example.com/p": "block", "http://example.com/p": "allow",
        "http://h.net/a/b/c/d/e/f/g?x": "block", "http://h.net/a/b/c/d/": "block", "http://h.net/a/b/c/": "allow", "http://h.net/a/b/c/dd/e": "allow",
        "http://z.a.b.c.d.e.f.g.deep.com/q/r": "block", "http://b.c.d.e.f.g.deep.com/q/r": "allow",
    }
    got = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), listed).collect()
    assert {list(urls)[x["page_id"]]: x["verdict"] for x in got} == urls
    none = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), listed.where("false")).collect()
    assert {x["verdict"] for x in none} == {"allow"}


def test_license_words_added_or_left_out_between_key_phrases(spark):
    mit, apache, bsd = (license_scan.TEMPLATES[k].text for k in (3, 4, 8))
    rows = [
        (1, "x " + mit.replace("person obtaining", "person or entity obtaining"), "", ""), (2, mit.replace("obtaining a copy", "obtaining copy"), "", ""),
        (3, apache.replace("you may obtain a copy", "you may also obtain a copy"), "", ""), (4, apache.replace("may not use", "may use"), "", ""),
        (5, bsd.replace("are permitted", "is expressly permitted"), "", ""), (6, mit.replace("person obtaining", "person " + "x " * 9 + "obtaining"), "", ""), (7, mit, "", ""),
    ]
    got = {x["doc_id"]: x for x in license_scan.scan(frame(spark, rows)).collect()}
    assert {k: x["labels"] for k, x in got.items()} == {1: "mit", 2: "mit", 3: "apache", 4: "apache", 5: "bsd", 6: "", 7: "mit"}
    assert [x["at"] for x in got[1]["places"]] == [1] and [x["at"] for x in got[4]["places"]] == [0]
    assert got[7]["score"] == pytest.approx(1) and got[1]["score"] > 0.5 and got[6]["score"] == 0


def test_short_and_mixed_values_behind_a_secrets_name(spark):
    rows = [(1, "the password: Tr0ub4dor&3 is old", "a", "x"), (2, 'set password="pa55!word#2024" now', "a", "x"), (3, "the note: wonderful words", "a", "x"), (None, f'token = "{SECRET}"', "a", "x")]
    found = secret_scan.scan(frame(spark, rows * 3)).collect()
    assert {x["doc_id"] for x in found if x["is_secret"]} == {1, 2, None} and {x["n_chars"] for x in found if x["doc_id"] in (1, 2)} == {11, 14}
    hidden = secret_scan.redacted(frame(spark, rows)).collect()
    assert sorted(x["text"] for x in hidden) == sorted(["the note: wonderful words", "the password: [SECRET] is old", 'set password="[SECRET]" now', 'token = "[SECRET]"'])


def test_findings_of_documents_and_the_language(spark):
    texts = [f"thing and other words token = {zlib.crc32(b'%d' % k):08x}{zlib.crc32(b'x%d' % k):08x} commit {zlib.crc32(b'y%d' % k):08x}{zlib.crc32(b'z%d' % k):08x} incomprehensibilities" for k in range(200)]
    docs = frame(spark, [(k, t, "s", "x") for k, t in enumerate(texts)])
    known = secret_scan.language(docs)
    chance = lambda a, b: known.chances[(ord(a) - 97) * 27 + ord(b) - 97]
    assert {"thing", "other", "words"} <= set(known.words) and chance("t", "h") > chance("t", "z")
    rows = secret_scan.document_findings(docs).withColumn("fold", secret_scan.F.crc32("found") % 4)
    assert {(x["label"], x["n"]) for x in rows.groupBy("label").agg(secret_scan.F.count("*").alias("n")).collect()} == {(1.0, 200), (0.0, 400)}
    model = secret_scan.train(rows.where("fold <> 2").unionByName(secret_scan.labelled_findings(spark).withColumn("fold", secret_scan.F.lit(0))), known=known)
    shown = model.transform(secret_scan.featured(rows.where("fold = 2 and before <> ''"), known)).select("label", "prediction").collect()
    assert len(shown) > 20 and sum(x["label"] == x["prediction"] for x in shown) >= 0.95 * len(shown)


def test_redaction_is_by_place(spark):
    """A secret that is part of another, or looks like a word elsewhere, is cut out where it stands and nowhere else."""
    a = "7Gk29xQzLm40PwVt"
    texts = [
        f'password = "{a}" then token = "{a}99ZrTq81"', f'  token = "{a}",\n\nsecret="{a}99ZrTq81" {a[:6]}x', "password: dragon9 and a dragon9fly here", f"token={a} {a}. no{a}", None, "", "plain words only",
    ]
    docs = frame(spark, [(k, t, "a", "x") for k, t in enumerate(texts)])
    found = secret_scan.scored(docs, None, "source").where("chance >= 0.5").select("doc_id", "word_at", "word", "found").collect()
    want = {}
    for k, text in enumerate(texts):
        parts = re.split(r"([ \t-\r]+)", text or "")
        words = [i for i, p in enumerate(parts) if p and not p.isspace()]
        for x in sorted({(x["word_at"], x["found"]) for x in found if x["doc_id"] == k}, key=lambda x: -len(x[1])):
            i = words[x[0]]
            runs = [m.start() for m in re.finditer(r"[A-Za-z0-9_+/=.-]*[A-Za-z0-9_+/=-]", parts[i]) if m.group() == x[1]]
            for at in reversed(runs or [parts[i].rindex(x[1])]):
                parts[i] = parts[i][:at] + "[SECRET]" + parts[i][at + len(x[1]) :]
        want[k] = None if text is None else "".join(parts)
    got = {x["doc_id"]: x["text"] for x in secret_scan.redacted(docs).collect()}
    assert got == want
    assert got[0] == 'password = "[SECRET]" then token = "[SECRET]"' and got[2] == "password: [SECRET] and a dragon9fly here"
