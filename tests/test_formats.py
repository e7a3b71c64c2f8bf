"""Conversions keep every part of random documents, find what is lost, and read Word files of any prefix."""

import io
import random
import zipfile

from folioweave.sources import formats
from folioweave.sources.formats import from_markdown, from_word, normal, to_markdown, to_word


def document(r):
    text = lambda n=12: "".join(r.choice([*"ab *_#<>{}|\\\n\t\r+-/.ß\x01é😀", "_x0041_", "<br>", "{+}", "{/>}", "**", "\n\n"]) for _ in range(r.randrange(n)))
    run = lambda: {"text": r.choice([text(), text(), None]), "bold": r.choice([True, False, None]), "italic": r.choice([True, False]), "suggested": r.choice(["", "", "ins", "del", None])}
    return [
        {"style": r.choice([None, "NORMAL_TEXT", "HEADING_1", "HEADING_6", "Title", "odd {}} style", "Heading2"]), "runs": [run() for _ in range(r.randrange(5))], "comments": [{"author": text(4), "content": text()} for _ in range(r.randrange(3))]}
        for _ in range(r.randrange(6))
    ]


def test_round_trips_keep_everything():
    r = random.Random(2)
    for _ in range(1500):
        m = document(r)
        assert from_markdown(to_markdown(m)) == normal(m) == from_word(to_word(m)) == normal(normal(m))


def test_columns_keep_what_functions_keep(spark):
    r = random.Random(4)
    docs = [document(r) for _ in range(40)] + [None, []]
    frame = spark.createDataFrame(list(enumerate(docs)), f"id long, paragraphs {formats.MODEL}")
    files = formats.converted(frame, md=("to_markdown", "paragraphs"), docx=("to_word", "paragraphs"))
    read = formats.converted(files, a=("from_markdown", "md"), b=("from_word", "docx"), n=("normal", "paragraphs")).collect()
    assert all(x["a"] == x["b"] == x["n"] for x in read)
    assert [p.asDict(True) for p in read[3]["n"]] == normal(docs[3])
    assert formats.losses(spark.createDataFrame(read), "id", "a", "n").count() == 0


def test_planted_losses_are_found_at_their_paragraph(spark):
    run = lambda text, bold=False, italic=False, suggested="": {"text": text, "bold": bold, "italic": italic, "suggested": suggested}
    p = lambda *runs, style="NORMAL_TEXT", comments=(): {"style": style, "runs": list(runs), "comments": list(comments)}
    note = {"author": "Ann", "content": "why?"}
    before = [p(run("a", True), run("b")), p(run("c"), style="HEADING_1"), p(run("d", italic=True)), p(run("e", suggested="ins")), p(run("f"), comments=[note]), p(run("g")), p(run("h"))]
    after = [p(run("ab")), p(run("c")), p(run("d")), p(run("e", suggested="del")), p(run("f")), p(run("g!"))]
    frame = spark.createDataFrame([(1, normal(before), normal(after)), (2, normal(before), normal(before))], f"id long, x {formats.MODEL}, y {formats.MODEL}")
    got = {tuple(r) for r in formats.losses(frame, "id", "x", "y").collect()}
    assert got == {(1, 0, "bold"), (1, 1, "style"), (1, 2, "italic"), (1, 3, "suggestion"), (1, 4, "comment"), (1, 5, "text"), (1, 6, "text")}


def test_word_files_of_any_prefix():
    xml = '<x:document xmlns:x="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><x:body><x:p><x:pPr><x:pStyle x:val="Heading2"/></x:pPr><x:r><x:rPr><x:b/><x:i x:val="false"/></x:rPr><x:t>One</x:t><x:tab/><x:t>&amp; two</x:t></x:r></x:p><x:tbl><x:p><x:del x:author="A"><x:r><x:delText>old</x:delText></x:r></x:del></x:p></x:tbl></x:body></x:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    assert from_word(out.getvalue()) == [
        {"style": "HEADING_2", "runs": [{"text": "One\t& two", "bold": True, "italic": False, "suggested": ""}], "comments": []},
        {"style": "NORMAL_TEXT", "runs": [{"text": "old", "bold": False, "italic": False, "suggested": "del"}], "comments": []},
    ]
    assert from_word(b"no archive") is None and from_word(None) is None


def test_conversions_hold_few_documents_at_a_time(spark):
    import pyarrow as pa

    from folioweave.functions.alignment import SLICE_BYTES, slices

    batch = pa.RecordBatch.from_pydict({"k": list(range(3001)), "text": ["x" * (k % 7) * 1000 for k in range(3000)] + ["y" * 3 * SLICE_BYTES]})
    parts = list(slices(batch, SLICE_BYTES))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and len(parts) > 9
    assert all(p.nbytes <= SLICE_BYTES or p.num_rows == 1 for p in parts) and list(slices(batch[:0], SLICE_BYTES))[0].num_rows == 0
    made = formats.converted(spark.range(6000).selectExpr("id", "array(struct('NORMAL_TEXT' as style, array(struct(repeat('x', 500) as text, false as bold, false as italic, '' as suggested)) as runs, cast(array() as array<struct<author:string,content:string>>) as comments)) as p").repartition(1), md=("to_markdown", "p"))
    assert made.select("id", "md").distinct().count() == 6000
