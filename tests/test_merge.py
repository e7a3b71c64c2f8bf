"""The three-way merge: nothing lost or doubled, the four kinds of conflicts, and shortest differences."""

import random
from collections import Counter

import pytest

from folioweave.functions.alignment import align, edit_script, matches
from folioweave.operators import conflicts

TURNS = "conv_id long, turn long, text string"
MODEL = "id long, base array<struct<text:string,format:string,note:string>>, ours array<struct<text:string,format:string,note:string>>, theirs array<struct<text:string,format:string,note:string>>"


def merged_texts(spark, cases, choose=conflicts.chosen_by_length):
    rows = [(k, n, t) for k, case in enumerate(cases) for n, t in enumerate(case)]
    found = conflicts.merged(choose(conflicts.with_kind(conflicts.paragraphs(spark.createDataFrame(rows, TURNS)))))
    return {r["conv_id"]: (r["text"], r["n_open"]) for r in conflicts.merged_texts(found, "conv_id").collect()}


def edited(r, lines, mark):
    out = []
    for x in lines:
        what = r.random()
        out += [] if what < 0.1 else [x + f" {mark}"] if what < 0.2 else [x, f"new {mark} {r.randrange(3)}"] if what < 0.3 else [x]
    if out and r.random() < 0.3:
        out.insert(r.randrange(len(out)), out.pop(r.randrange(len(out))))
    return out


def test_insertion_above_a_change_is_no_conflict(spark):
    assert merged_texts(spark, [("A\nB\nC\nD", "New line.\nA\nB\nC\nD", "A\nB\nC changed\nD")])[0] == ("New line.\nA\nB\nC changed\nD", 0)


def test_one_changed_side_is_the_result(spark):
    r = random.Random(3)
    cases = []
    for k in range(60):
        base = [r.choice(("a b", "c", "d e f", "", "x y z w", f"line {r.randrange(9)}")) for _ in range(r.randrange(1, 14))]
        side = edited(r, base, "mine") if k % 3 else [r.choice(("p", "q", "a b")) for _ in range(r.randrange(5))]
        b, x = "\n".join(base), "\n".join(side)
        cases += [(b, x, b), (b, b, x), (b, x, x)]
    got = merged_texts(spark, cases)
    for k, (b, o, t) in enumerate(cases):
        assert got[k] == (t if o == b else o, 0), cases[k]


def test_no_line_is_lost_or_doubled(spark):
    r = random.Random(8)
    cases = []
    for _ in range(60):
        base = [f"{k} words of paragraph {k}" for k in range(r.randrange(2, 14))]
        cases.append(("\n".join(base), "\n".join(edited(r, base, "ours")), "\n".join(edited(r, base, "theirs"))))
    got = merged_texts(spark, cases, conflicts.undecided)  # conflicts stand with both sides
    for k, (b, o, t) in enumerate(cases):
        base, ours, theirs, lines = (Counter(x.split("\n")) for x in (b, o, t, got[k][0]))
        for x in ours | theirs:
            both_moved = lines[x] == 2 and x in base and f"{conflicts.OURS}\n{x}\n{conflicts.BETWEEN}\n{x}\n" in got[k][0]
            if x.startswith("new"):
                assert lines[x] >= max(ours[x], theirs[x]), (x, cases[k], got[k])
            elif x not in base:  # a changed paragraph stands once, unless the other side deleted it
                assert lines[x] == 1
            elif ours[x] and theirs[x]:
                assert lines[x] == 1 or both_moved, (x, cases[k], got[k])
        outside = got[k][0].split("\n")
        while conflicts.OURS in outside:
            at, end = outside.index(conflicts.OURS), outside.index(conflicts.THEIRS)
            outside[at : end + 1] = []
        assert max(Counter(x.split(" ")[0] for x in outside if x[:1].isdigit()).values(), default=1) == 1


def test_all_kinds_of_conflicts(spark):
    p = lambda text, style="body", note="": (text, style, note)
    base = [p(f"{k} stands here unchanged as it was") for k in range(10)]
    ours, theirs = list(base), list(base)
    ours[1], theirs[1] = p("1 stands here ours as it was"), p("1 stands here theirs as it was")
    ours[2], theirs[2] = p(base[2][0], "h1"), p(base[2][0], "h2")
    ours[3], theirs[3] = p(base[3][0], note="a"), p(base[3][0], note="b")
    ours[4], theirs[4] = p(base[4][0], "quote"), p("4 stands here changed as it was", note="c")
    theirs[5] = p("5 stands here changed as it was")
    del ours[5]
    ours.append(ours.pop(0))
    theirs.insert(6, theirs.pop(0))
    frame = spark.createDataFrame([(1, base, ours, theirs), (2, base, base, None), (3, None, ours[:1], ours[:2]), (4, [], None, None)], MODEL)
    rows = conflicts.with_kind(conflicts.aligned(frame, "id")).cache()
    got = {r["anchor"]: r["kinds"] for r in rows.where("id = 1 and size(kinds) > 0").collect()}
    assert got == {0: ["structural"], 1: ["text"], 2: ["formatting"], 3: ["metadata"], 5: ["structural"]}
    done = conflicts.merged(conflicts.chosen_by_length(rows))
    four = done.where("id = 1 and anchor = 4").first()
    assert (four["merged"], four["format"], four["note"]) == ("4 stands here changed as it was", "quote", "c")
    five = done.where("id = 1 and anchor = 5").first()
    assert (five["choice"], five["merged"], five["kept"]) == ("edit", base[5][0], True)
    assert done.where("id = 1 and anchor = 0").first()["merged"] is None
    texts = {r["id"]: (r["text"], r["n_open"]) for r in conflicts.merged_texts(done, "id").collect()}
    assert texts[1][1] == 1 and texts[1][0].endswith(f"{conflicts.OURS}\n{base[0][0]}\n{conflicts.BETWEEN}\n{base[0][0]}\n{conflicts.THEIRS}")
    assert texts[2] == ("", 0) and texts[3] == ("\n".join(x[0] for x in ours[:2]), 0)


def test_moves_are_structure_and_keep_edits(spark):
    base = "first goes away\nsecond one stays\nthird one stays\nfourth one stays"
    got = merged_texts(spark, [(base, "second one stays\nthird one stays\nfourth one stays\nfirst goes away", base.replace("third one", "third changed"))])
    assert got[0] == ("second one stays\nthird changed stays\nfourth one stays\nfirst goes away", 0)


def shortest(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return len(a) + len(b) - 2 * t[-1][-1]


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefghijkl"])
def test_differences_are_shortest(letters):
    r = random.Random(5)
    for _ in range(1500):
        a, b = ([r.choice(letters) for _ in range(r.randrange(12))] for _ in range(2))
        script = list(edit_script(a, b))
        assert [x for op, x in script if op != "+"] == a and [x for op, x in script if op != "-"] == b
        assert sum(op != " " for op, _ in script) == shortest(a, b)
        found = matches(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False))
        places = [x[0] for x in align(a, b) if x[0] >= 0]
        assert len(set(places)) == len(places)


def test_long_orders_are_quick():
    r = random.Random(1)
    a = [str(k) for k in range(40_000)]
    b = a[:]
    r.shuffle(b)
    assert len(matches(a, b)) > 100
    assert len(matches(a, [f"x{k}" if k % 50 == 0 else x for k, x in enumerate(a)])) == 39_200


def test_three_sides_are_aligned_in_one_pass(spark, tmp_path):
    texts = [["a", "b", "c"], ["c", "a"], ["a", "b", "new"]]
    rows = [(1, *[[(x, "body", "") for x in t] for t in texts]), (2, None, [("x", "body", "")], None)]
    spark.createDataFrame(rows, MODEL).write.parquet(str(tmp_path / "v"))
    found = conflicts.aligned(spark.read.parquet(str(tmp_path / "v")), "id")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = sorted((r["id"], r["anchor"], r["added"], *[r[s] and r[s]["text"] for s in conflicts.SIDES]) for r in found.collect())
    assert got == [(1, 0, False, "a", "a", "a"), (1, 1, False, "b", None, "b"), (1, 2, False, "c", "c", "new"), (2, -1, True, None, "x", None)]


def test_both_touched_is_one_pass(spark):
    from folioweave.plans.history import _both_touched

    docs = spark.createDataFrame([(k, "\n".join(f"line {i}." for i in range(20))) for k in range(5)], "doc_id long, text string").repartition(2)
    assert _both_touched(docs)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
