"""Golden values and properties of the document operators."""

import datetime
import io
import json
import random
import re
import zipfile
import zlib

from folioweave.functions import text as T
from folioweave.operators import access, activity, commits, conflicts, records, references, reports, versions
from folioweave.sources import drive, word
from folioweave.streaming import replay
from pyspark.sql import functions as F


def test_roles(spark):
    rows = spark.createDataFrame([("owner",), ("writer",), ("commenter",), ("reader",), ("other",), (None,)], "r string")
    assert [x[0] for x in rows.select(access.repository_role(F.col("r"))).collect()] == ["maintainer", "developer", "reporter", "guest", "guest", "guest"]


def test_messages(spark):
    good = ["feat: add termination clause section 12", "review: incorporate client feedback on liability", "final: version for client signature"]
    bad = ["update clause", "wrong: type", "feat:no space", "feat: " + "x" * 50, None]
    rows = spark.createDataFrame([(m,) for m in good + bad], "m string").select(T.message_is_valid(F.col("m"))).collect()
    assert [x[0] for x in rows] == [True] * 3 + [False] * 5


def test_references(spark):
    row = spark.createDataFrame([("see firm://matter-abc/contract/section-5 now",)], "t string").select(T.references(F.col("t"))[0].alias("u")).select(T.reference_parts(F.col("u")).alias("p")).first()
    assert (row.p.authority, row.p.segments) == ("matter-abc", ["contract", "section-5"])


def test_names_and_scans(spark):
    r = spark.createDataFrame([("Contract_v3_final_FINAL_revised.docx", "ssn 123-45-6789 by a.b@c.de")], "n string, t string")
    assert r.select(T.base_name(F.col("n")), T.masked(F.col("t")), T.matches(F.col("t"), T.SSN)).first()[:] == ("contract.docx", "ssn [SSN] by [EMAIL]", 1)


def test_revenue(spark):
    got = {x["year"]: x["total"] for x in activity.revenue_rollup(spark).where("tier is null").collect()}
    assert (got[1], got[2], got[3]) == (240_000, 1_560_000, 6_120_000)
    assert {x["grp"]: x["total"] for x in activity.cost_rollup(spark).collect() if x["grp"]} == {"infrastructure": 53, "legal": 45, "operations": 200}


def test_merge_and_conflicts(spark):
    rows = spark.createDataFrame([("a", "x", "x", "x"), ("b", "shall", "must", "shall"), ("c", "shall", "must", "will"), ("d", "x", None, "y"), ("e", "x", "y", "y")], "anchor string, base string, ours string, theirs string")
    assert [(r["kind"], r["merged"]) for r in versions.conflicts(rows).orderBy("anchor").collect()] == [(None, "x"), (None, "must"), ("text", None), ("structural", None), (None, "y")]


def test_tampering_is_seen(spark):
    v = spark.createDataFrame([(1, k, f"text {k}") for k in range(5)], "conv_id long, turn long, text string")
    links = versions.hash_links(v)
    assert versions.broken_links(links, v).count() == 0
    forged = v.withColumn("text", F.when(F.col("turn") == 2, "forged").otherwise(F.col("text")))
    assert {r["turn"] for r in versions.broken_links(links, forged).collect()} == {2, 3}


def test_reachability_with_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "a long, b long")
    assert {tuple(r) for r in access.reachable(edges).collect()} == {(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3)}


def test_word_files(spark, tmp_path):
    xml = '<w:document><w:body><w:p><w:r><w:t>One &amp; </w:t></w:r><w:r><w:t xml:space="preserve">two</w:t></w:r></w:p><w:p><w:ins w:author="Ann"><w:r><w:t>new</w:t></w:r></w:ins></w:p></w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no archive")
    parts = word.word_parts(spark, str(tmp_path)).cache()
    assert [(r["pos"], r["text"]) for r in word.paragraphs(parts).orderBy("pos").collect()] == [(0, "One & two"), (1, "new")]
    assert [tuple(r)[1:] for r in word.tracked_changes(parts).collect()] == [("ins", "Ann", "new")]


def test_lock_stream_refuses_a_second_holder(spark, tmp_path):
    rows = [(1, "signup"), (2, "signup"), (3, "purchase"), (4, "signup")]
    spark.createDataFrame([(i, "2026-01-01 00:00:0%d" % i, 7, k) for i, k in rows], "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = replay.run(spark, replay.lock_counts(replay.event_stream(spark, str(tmp_path / "events.parquet"))), "update").collect()
    assert [tuple(r) for r in got] == [(7, True, 2, 1)]


def test_levenshtein(spark):
    assert spark.createDataFrame([("kitten", "sitting")], "a string, b string").select(F.levenshtein("a", "b")).first()[0] == 3


def test_commit_types_are_in_the_vocabulary():
    assert set(commits.TYPE_OF.values()) <= set(T.COMMIT_TYPES)


def test_word_styles_formats_and_comments(spark, tmp_path):
    xml = '<w:body><w:p/><w:p w:x="1"><w:pPr><w:pStyle w:val="Heading1"/><w:jc w:val="center"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>Term</w:t></w:r></w:p><w:p><w:r><w:rPr><w:i w:val="0"/><w:u w:val="single"/></w:rPr><w:t>x</w:t></w:r></w:p></w:body>'
    notes = '<w:comments><w:comment w:id="3" w:author="Ann"><w:p><w:r><w:t>Why &lt; 5?</w:t></w:r></w:p></w:comment></w:comments>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", xml)
        z.writestr("word/comments.xml", notes)
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    parts = word.word_parts(spark, str(tmp_path)).cache()
    got = [(r["pos"], r["text"], r["style"], r["formatting"]["bold"], r["formatting"]["italic"], r["formatting"]["underline"], r["formatting"]["alignment"]) for r in word.paragraphs(parts).orderBy("pos").collect()]
    assert got == [(0, "", "Normal", "false", "false", "false", "left"), (1, "Term", "Heading1", "true", "false", "false", "center"), (2, "x", "Normal", "false", "false", "true", "left")]
    assert [tuple(r)[1:] for r in word.comments(parts).collect()] == [("3", "Ann", "Why < 5?")]


def test_docs_form(spark, tmp_path):
    doc = {
        "documentId": "d1", "title": "NDA", "modifiedTime": "2026-01-02T03:04:05Z", "lastModifyingUser": "ann@firm.example", "comments": [{"author": "Bob", "content": "ok?"}],
        "body": {"content": [
            {"paragraph": {"paragraphStyle": {"namedStyleType": "HEADING_2"}, "elements": [{"textRun": {"content": "Terms"}}]}},
            {"paragraph": {"elements": [{"textRun": {"content": "The party "}}, {"textRun": {"content": "must", "textStyle": {"bold": True, "italic": True}, "suggestedInsertionIds": ["s1"]}}]}},
        ]},
    }
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "d.json").write_text(json.dumps(doc))
    found = drive.extracted(drive.documents(spark, str(tmp_path)))
    row = drive.git_content(found).first()
    assert row["content"] == "## Terms\n\nThe party ***must***"
    assert (row["metadata"]["title"], row["metadata"]["author"], row["metadata"]["suggestions"], row["metadata"]["formatting"]) == ("NDA", "ann@firm.example", ["must"], ["HEADING_2", "NORMAL_TEXT"])
    assert [r["path"].endswith("x/d.json") for r in drive.files(spark, str(tmp_path)).collect()] == [True]
    assert drive.originals(spark, str(tmp_path), drive.files(spark, str(tmp_path))).first()["content"] == json.dumps(doc).encode()
    (tmp_path / "x" / "n.md").write_text("# one\ntwo")
    assert [r["text"] for r in drive.shadow_texts(spark, str(tmp_path)).collect()] == ["# one\ntwo"]


def test_git_log(spark, tmp_path):
    (tmp_path / "log").write_text("\x1eabc\x1fp1 p2\x1fAnn\x1f2026-01-02T03:04:05Z\x1ffeat: one\n\n3\t1\ta.md\n-\t-\tb.bin\n\x1edef\x1f\x1fBob\x1f2026-01-01T00:00:00Z\x1fdraft: two\n")
    got = {r["hash"]: (r["parents"], r["author"], r["message"], [tuple(f) for f in r["files"]]) for r in drive.commits(spark, str(tmp_path / "log")).collect()}
    assert got == {"abc": (["p1", "p2"], "Ann", "feat: one", [("a.md", 3, 1), ("b.bin", 0, 0)]), "def": ([], "Bob", "draft: two", [])}


def test_ordered_difference_makes_the_new_text(spark):
    texts = ["a\nb\nc\na", "a\nc\nd", "", None, "x\na\nb\nb"]
    v = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "conv_id long, turn long, text string")
    rows = conflicts.ordered_diff(v).orderBy("turn", "pos").collect()
    for k in range(1, len(texts)):
        own = [r for r in rows if r["turn"] == k]
        assert "\n".join(r["line"] for r in own if r["op"] != "+") == (texts[k - 1] or "") and "\n".join(r["line"] for r in own if r["op"] != "-") == (texts[k] or "")


def test_conflict_kinds(spark):
    rows = [(1, 0, "Terms\nThe party shall deliver goods.\nkeep\ngone"), (1, 1, "Terms.\nThe party must deliver goods.\nkeep (a)\nchanged"), (1, 2, "Terms.\nThe party will deliver goods.\nkeep (b)")]
    got = {r["anchor"]: r for r in conflicts.merged(conflicts.chosen_by_length(conflicts.with_kind(conflicts.paragraphs(spark.createDataFrame(rows, "conv_id long, turn long, text string"))))).collect()}
    assert [got[k]["kind"] for k in range(4)] == [None, "text", "text", "structural"]
    assert [got[k]["merged"] for k in range(4)] == ["Terms.", "The party must deliver goods.", "keep (a)", "gone"]


def test_lock_lifecycle_equals_a_machine_stepped_by_hand(spark, tmp_path):
    r = random.Random(4)
    start = datetime.datetime(2026, 1, 1)
    rows, at = [], start
    for k in range(400):
        at += datetime.timedelta(minutes=r.choice([5, 30, 300]))
        rows.append((k, at, r.randrange(6), r.choice(["signup", "signup", "purchase"]), float(r.choice([1, 1, 1, 500]))))
    for n in range(4):
        spark.createDataFrame(rows[100 * n : 100 * n + 100], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    want, held = set(), {}
    for k, ts, user, kind, value in rows:
        d = user % 2
        if d in held and ts > held[d][1]:
            want.add((d, held[d][2], "expired", held.pop(d)[0]))
        if kind == "signup":
            if d not in held or value > 200:
                want.add((d, k, "overridden" if d in held else "granted", user))
                held[d] = (user, ts + datetime.timedelta(hours=12), k)
            else:
                want.add((d, k, "refused", user))
        elif d in held and held[d][0] == user:
            want.add((d, k, "released", user))
            del held[d]
    stream = replay.event_stream(spark, str(tmp_path / "events.parquet"), files_per_trigger=1)
    got = {tuple(x) for x in replay.run(spark, replay.lock_lifecycle(stream, documents=2), "append").collect()}
    # Files of one second are read in any order, so only a table read in one trigger has a fixed order.
    whole = {tuple(x) for x in replay.run(spark, replay.lock_lifecycle(replay.event_stream(spark, str(tmp_path / "events.parquet"), 99), documents=2), "append").collect()}
    ended = {(d, k, "expired", u) for d, (u, _, k) in held.items()}
    assert want <= whole <= want | ended and {x[2] for x in want} == {"granted", "refused", "released", "expired", "overridden"}
    assert {x[1] for x in got if x[2] in ("granted", "refused", "overridden")} == {x[0] for x in rows if x[3] == "signup"}


def test_hooks_run_in_order(spark):
    seen, hooks = [], replay.Hooks()
    hooks.register("onCommit", lambda df: seen.append(("index", df.count())))
    hooks.register("onCommit", lambda df: seen.append(("mail", df.count())))
    hooks.trigger("onCommit", spark.range(3))
    assert seen == [("index", 3), ("mail", 3)]
    try:
        hooks.register("onSomething", print)
    except ValueError:
        seen.append("refused")
    assert seen[-1] == "refused"


def test_commit_index(spark, tmp_path):
    o = spark.createDataFrame([(1, 7, "O", "2-HIGH"), (2, 7, "P", "5-LOW")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").withColumn("o_orderdate", F.lit("2026-01-02 03:04:05").cast("timestamp_ntz"))
    f = spark.createDataFrame([(1, 5, 1, 15.0, "A"), (1, 6, 2, 3.0, "R")], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string")
    found = records.records(o, f)
    entry = {r["message"]: r for r in records.index_entries(found).collect()}["feat: update clause 1"]
    words = re.findall("[a-z0-9]+", "feat: update clause 1 -clause-6.md +clause-5.md".lower())
    counts = [0.0] * records.DIMENSIONS
    for w in words:
        counts[zlib.crc32(w.encode()) % records.DIMENSIONS] += 1
    norm = sum(x * x for x in counts) ** 0.5
    assert all(abs(a - b / norm) < 1e-6 for a, b in zip(entry["embedding"], counts, strict=True)) and entry["changes"]["added"] == ["clause-5.md"]
    for _ in range(2):
        records.append(found, str(tmp_path / "history"), F.concat(F.lit("matter-"), F.col("author")))
    back = spark.read.parquet(str(tmp_path / "history"))
    assert back.count() == 4 and {r["repo"] for r in back.collect()} == {"matter-7"}


def test_branch_and_tag_names(spark):
    r = spark.createDataFrame([("client-review", "client-abc-final-v1.0"), ("Client Review", "v1")], "b string, t string")
    got = r.select(reports.branch_is_valid(F.col("b")).alias("ok"), reports.tag_parts(F.col("t")).alias("p")).collect()
    assert [(x["ok"], x["p"]["client"], x["p"]["major"]) for x in got] == [(True, "abc", "1"), (False, "", "")]


def test_placeholders(spark):
    texts = spark.createDataFrame([(1, "as {{termination-clause}} and {{gone}} say"), (2, None)], "doc_id long, text string")
    numbers = spark.createDataFrame([(1, "termination-clause", "12.3")], "doc_id long, anchor string, number string")
    assert {r["doc_id"]: r["text"] for r in references.rendered(texts, numbers).collect()} == {1: "as Section 12.3 and {{gone}} say", 2: None}
