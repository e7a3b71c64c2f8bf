"""The license scan against a search of every place of every text."""

import math
import random
import re

import pytest

from folioweave.llm import license_scan as L


def plain(texts):
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    idf = {w: math.log((len(texts) + 1) / (sum(w in x for x in words) + 1)) + 1e-6 for t in L.TEMPLATES for w in t.words}
    out = []
    for own in words:
        found = []
        for t in L.TEMPLATES:
            slack = L.SLACK if t.keys else 0
            first = {w: i for i, w in reversed(list(enumerate(t.words)))}
            rare = sorted(first, key=lambda w: (-idf[w], first[w]))[: L.RARE_WORDS]
            keys = t.key_places()
            for begin in range(len(own)):
                at = begin - keys[0][0]
                if at < -slack or own[begin : begin + len(keys[0][1])] != keys[0][1]:
                    continue
                if not all(any(at + p + d >= 0 and own[at + p + d : at + p + d + len(k)] == k for d in range(-n * slack, n * slack + 1)) for n, (p, k) in enumerate(keys)):
                    continue
                wide = max(1, len(t.keys) - 1) * slack
                votes = sum(idf[w] for w in rare if any(0 <= at + first[w] + d < len(own) and own[at + first[w] + d] == w for d in range(-wide, wide + 1)))
                share = min(votes / sum(idf[w] for w in rare), 1.0)
                if t.base or share >= L.LEAST_SHARE:
                    found.append((t.label, t.base, max(at, 0), share))
        base = [x for x in found if x[1]]
        out.append((len(own), len(base), min((x[2] for x in base), default=None), max((x[2] for x in base), default=None), ",".join(sorted({x[0] for x in base})), ",".join(sorted({x[0] for x in found})), max((x[3] for x in found), default=0.0)))
    return out


def test_scan_equals_a_search_of_every_place(spark):
    r = random.Random(8)
    noise = "the and of to in software license public general free use with or notice this".split()

    def altered(t):
        words = list(t.words)
        for _ in range(r.randrange(6)):
            at = r.randrange(len(words) or 1)
            words[at : at + 1] = r.choice(([], words[at : at + 1] + ["zzz"], ["yyy"], words[at : at + 1]))
        return words

    texts = [None, "", "MIT License", "license " * 3000, "mit license mit License, apache-license"]
    for _ in range(120):
        words = []
        for _ in range(r.randint(1, 3)):
            words += [r.choice(noise) for _ in range(r.randrange(30))] + altered(r.choice(L.TEMPLATES))
        texts.append(r.choice((" ", ", ")).join(w.upper() if r.random() < 0.1 else w for w in words))
    docs = spark.createDataFrame([(k, t, "a", "b", 3) for k, t in enumerate(texts)], "doc_id long, text string, words string, places string, n_words int")
    got = {x["doc_id"]: x for x in L.scan(docs).collect()}
    for k, want in enumerate(plain(texts)):
        x = got[k]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"], x["labels"]) == want[:-1], texts[k]
        assert x["score"] == pytest.approx(want[-1], abs=1e-9)
    assert sum(bool(w[5]) for w in plain(texts)) > 40 and any(w[5] != w[4] for w in plain(texts))


def test_a_template_without_its_rare_words_is_no_match(spark):
    t = L.TEMPLATES[25]
    keys = {w for _, k in t.key_places() for w in k}
    gutted = " ".join(w if w in keys else "zzz" for w in t.words)
    docs = spark.createDataFrame([(1, t.words[0] + " " + " ".join(t.words), ""), (2, gutted, "")] + [(k, "the software the copies", "") for k in range(3, 40)], "doc_id long, text string, x string")
    got = {x["doc_id"]: x["labels"] for x in L.scan(docs).collect()}
    assert got[1] == "mit" and got[2] == ""
