"""Documents as paragraphs of runs, to Markdown and Word files and back without loss."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alignment import SLICE_BYTES, slices

#: A document's paragraphs. ``suggested`` is ins, del or empty.
MODEL = "array<struct<style:string,runs:array<struct<text:string,bold:boolean,italic:boolean,suggested:string>>,comments:array<struct<author:string,content:string>>>>"
_run = pa.struct([("text", pa.string()), ("bold", pa.bool_()), ("italic", pa.bool_()), ("suggested", pa.string())])
_model = pa.list_(pa.struct([("style", pa.string()), ("runs", pa.list_(_run)), ("comments", pa.list_(pa.struct([("author", pa.string()), ("content", pa.string())])))]))
NORMAL = "NORMAL_TEXT"
#: The namespaces of Word's XML.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
CONTENT_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/comments.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.comments+xml"/></Types>'
RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="{}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{}" Target="{}"/></Relationships>'


def normal(paragraphs: list[dict] | None) -> list[dict]:
    """One form for what means the same: neighbouring runs of one look are one run, empty ones none, nulls false or empty, no paragraph without a style, and one empty paragraph is no text."""
    out = []
    for p in paragraphs or []:
        runs: list[dict] = []
        for r in p["runs"] or []:
            look = (bool(r["bold"]), bool(r["italic"]), r["suggested"] or "")
            if runs and tuple(runs[-1].values())[1:] == look:
                runs[-1]["text"] += r["text"] or ""
            elif r["text"]:
                runs.append(dict(zip(("text", "bold", "italic", "suggested"), (r["text"], *look), strict=True)))
        style = re.sub(r"\AHeading([1-6])\Z", r"HEADING_\1", p["style"] or NORMAL)
        out.append({"style": style, "runs": runs, "comments": [{"author": c["author"] or "", "content": c["content"] or ""} for c in p["comments"] or []]})
    return [] if out == [{"style": NORMAL, "runs": [], "comments": []}] else out


# Markdown: signs of the text are escaped, so that every mark in it is one ----------------------

_escaped = re.compile(r"[\\*_#<>{}|]")
_tokens = re.compile(r"(?s)\\.|\*\*|_|<br>|\{/?[+>-]\}|\||[^\\*_<{|]+").findall
OPEN = {"ins": "{+}", "del": "{-}"}
CLOSE = {"ins": "{/+}", "del": "{/-}"}


def _escape(text: str) -> str:
    return _escaped.sub(lambda m: "\\" + m.group(), text).replace("\n", "<br>")


def to_markdown(paragraphs: list[dict] | None) -> str:
    """Paragraphs stand a line apart. Headings begin with #, other styles with their name; ** is bold, _ italic, suggestions and comments stand in braces."""
    lines = []
    for p in normal(paragraphs):
        heading = re.fullmatch("HEADING_([1-6])", p["style"])
        head = "#" * int(heading[1]) + " " if heading else "" if p["style"] == NORMAL else f"{{.{_escape(p['style'])}}} "
        body = ""
        for r in p["runs"]:
            marks = ("**" if r["bold"] else "") + ("_" if r["italic"] else "")
            body += OPEN.get(r["suggested"], "") + marks + _escape(r["text"]) + marks[::-1] + CLOSE.get(r["suggested"], "")
        lines.append(head + body + "".join(f"{{>}}{_escape(c['author'])}|{_escape(c['content'])}{{/>}}" for c in p["comments"]))
    return "\n\n".join(lines)


def from_markdown(text: str | None) -> list[dict]:
    """The paragraphs of what to_markdown() wrote."""
    found = []
    for line in text.split("\n\n") if text else []:
        style = NORMAL
        if m := re.match(r"(#{1,6}) ", line):
            style, line = f"HEADING_{len(m[1])}", line[m.end() :]
        elif m := re.match(r"(?s)\{\.((?:\\.|[^\\}])*)\} ", line):
            style, line = "".join(_plain(t) for t in _tokens(m[1])), line[m.end() :]
        runs, comments, bold, italic, suggested, note = [], [], False, False, "", None
        for t in _tokens(line):
            if t == "**":
                bold = not bold
            elif t == "_":
                italic = not italic
            elif t in ("{+}", "{-}"):
                suggested = "ins" if t == "{+}" else "del"
            elif t in ("{/+}", "{/-}"):
                suggested = ""
            elif t == "{>}":
                note = [""]
            elif t == "|" and note is not None:
                note.append("")
            elif t == "{/>}":
                comments.append({"author": note[0], "content": note[1]})
                note = None
            elif note is not None:
                note[-1] += _plain(t)
            else:
                runs.append({"text": _plain(t), "bold": bold, "italic": italic, "suggested": suggested})
        found.append({"style": style, "runs": runs, "comments": comments})
    return normal(found)


def _plain(token: str) -> str:
    return "\n" if token == "<br>" else token[1:] if token[0] == "\\" else token


# Word: runs, styles, tracked changes and comments ---------------------------------------------

_unwritable = re.compile(r"_x[0-9A-F]{4}_|[\x00-\x08\x0b-\x1f￾￿]")
_written = re.compile("_x([0-9A-F]{4})_").sub


def _guarded(text: str) -> str:
    """What XML can't hold goes as _xHHHH_, and what looks so has its first sign written that way."""
    return _unwritable.sub(lambda m: f"_x{ord(m.group()):04X}_" if len(m.group()) == 1 else "_x005F" + m.group(), text)


def _read(text: str) -> str:
    return _written(lambda m: chr(int(m[1], 16)), text)


def _xml(text: str) -> str:
    return _guarded(text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _word_run(text: str, tag: str, looks: str = "") -> str:
    parts = [f'<w:{tag} xml:space="preserve">{_xml(x)}</w:{tag}>' if x else "" for x in text.split("\n")]
    return f"<w:r>{looks}{'<w:br/>'.join(parts)}</w:r>"


def to_word(paragraphs: list[dict] | None) -> bytes:
    """A .docx of the paragraphs."""
    body, notes = [], []
    for p in normal(paragraphs):
        style = re.sub("\\AHEADING_([1-6])\\Z", r"Heading\1", p["style"])
        body.append("<w:p>" + ("" if style == NORMAL else f'<w:pPr><w:pStyle w:val="{_in_attribute(style)}"/></w:pPr>'))
        for r in p["runs"]:
            looks = "<w:b/>" * r["bold"] + "<w:i/>" * r["italic"]
            run = _word_run(r["text"], "delText" if r["suggested"] == "del" else "t", f"<w:rPr>{looks}</w:rPr>" if looks else "")
            body.append(f'<w:{r["suggested"]} w:author="suggested">{run}</w:{r["suggested"]}>' if r["suggested"] else run)
        for c in p["comments"]:
            body.append(f'<w:r><w:commentReference w:id="{len(notes)}"/></w:r>')
            notes.append(f'<w:comment w:id="{len(notes)}" w:author="{_in_attribute(c["author"])}"><w:p>{_word_run(c["content"], "t")}</w:p></w:comment>')
        body.append("</w:p>")
    out, head, space = io.BytesIO(), '<?xml version="1.0" encoding="UTF-8"?>', f'xmlns:w="{W[1:-1]}"'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        z.writestr("[Content_Types].xml", CONTENT_TYPES)
        z.writestr("_rels/.rels", RELS.format("r1", "officeDocument", "word/document.xml"))
        z.writestr("word/_rels/document.xml.rels", RELS.format("r2", "comments", "comments.xml"))
        z.writestr("word/document.xml", f"{head}<w:document {space}><w:body>{''.join(body)}</w:body></w:document>")
        z.writestr("word/comments.xml", f"{head}<w:comments {space}>{''.join(notes)}</w:comments>")
    return out.getvalue()


def _in_attribute(text: str) -> str:
    """White space in an attribute would be read as blanks."""
    return _xml(text).replace("\n", "_x000A_").replace("\t", "_x0009_")


def from_word(content: bytes | None) -> list[dict] | None:
    """The paragraphs of a .docx, by namespace, whatever its prefixes; null if it isn't one."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content or b""))
        root = ET.fromstring(z.read("word/document.xml"))
        notes = ET.fromstring(z.read("word/comments.xml")) if "word/comments.xml" in z.namelist() else ET.Element("none")
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return None

    def text(r: ET.Element) -> str:
        return "".join("\n" if x.tag in (f"{W}br", f"{W}cr") else "\t" if x.tag == f"{W}tab" else _read(x.text or "") if x.tag in (f"{W}t", f"{W}delText") else "" for x in r)

    def on(r: ET.Element, name: str) -> bool:
        x = r.find(f"{W}rPr/{W}{name}")
        return x is not None and x.get(f"{W}val", "1") not in ("0", "false", "none", "off")

    said = {c.get(f"{W}id"): {"author": _read(c.get(f"{W}author") or ""), "content": "\n".join("".join(text(r) for r in p.iter(f"{W}r")) for p in c.iter(f"{W}p"))} for c in notes.iter(f"{W}comment")}
    found = []
    for p in root.iter(f"{W}p"):
        runs = []

        def walk(parent: ET.Element, suggested: str, runs: list[dict] = runs) -> None:
            for x in parent:
                if x.tag == f"{W}r":
                    runs.append({"text": text(x), "bold": on(x, "b"), "italic": on(x, "i"), "suggested": suggested})
                elif x.tag != f"{W}pPr":
                    walk(x, {f"{W}ins": "ins", f"{W}del": "del"}.get(x.tag, suggested))

        walk(p, "")
        style = p.find(f"{W}pPr/{W}pStyle")
        comments = [said[i] for x in p.iter(f"{W}commentReference") if (i := x.get(f"{W}id")) in said]
        found.append({"style": None if style is None else _read(style.get(f"{W}val") or ""), "runs": runs, "comments": comments})
    return normal(found)


def plain(paragraphs: list[dict] | None) -> list[dict]:
    """The paragraphs by way of text alone, which loses all but the words."""
    return normal([{"style": None, "runs": [{"text": "".join(r["text"] or "" for r in p["runs"] or []), "bold": False, "italic": False, "suggested": ""}], "comments": []} for p in paragraphs or []])


# Columns ---------------------------------------------------------------------------------------


#: What a column of another can be made by: its type in Spark and in Arrow, and the function.
CONVERSIONS: dict[str, tuple[str, pa.DataType, Callable]] = {
    "to_markdown": ("string", pa.string(), to_markdown), "to_word": ("binary", pa.binary(), to_word), "from_markdown": (MODEL, _model, from_markdown),
    "from_word": (MODEL, _model, from_word), "normal": (MODEL, _model, normal), "plain": (MODEL, _model, plain),
}


def converted(df: DataFrame, **made: tuple[str, str]) -> DataFrame:
    """Adds columns, each by a conversion of another column: ``markdown=("to_markdown", "paragraphs")``. All are made in one pass over Arrow batches.

    Documents as Python objects take many times their size, so a task holds those of about SLICE_BYTES at a time, one document at least.
    """
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{name}` {CONVERSIONS[how][0]}" for name, (how, _) in made.items()])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices(batch, SLICE_BYTES)):
            read = {source: b[source].to_pylist() for source in {source for _, source in made.values()}}
            new = [pa.array([CONVERSIONS[how][2](x) for x in read[source]], CONVERSIONS[how][1]) for how, source in made.values()]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *made])

    return df.mapInArrow(each, schema)


#: Parts of a paragraph that a conversion may lose.
PARTS = ("text", "style", "bold", "italic", "suggestion", "comment")


def _part(p: Column, part: str) -> Column:
    looks = {"bold": "bold", "italic": "italic", "suggestion": "suggested"}
    if part in looks:
        # What has the look: its text, joined, with a sign between runs that stand apart.
        return F.array_join(F.transform(p["runs"], lambda r: F.when(r[looks[part]] if part != "suggestion" else r["suggested"] != "", F.concat(F.when(r["suggested"] != "", r["suggested"]).otherwise("") if part == "suggestion" else F.lit(""), r["text"])).otherwise("\0")), "")
    return {"text": F.array_join(F.transform(p["runs"], lambda r: r["text"]), ""), "style": p["style"], "comment": F.to_json(p["comments"])}[part]


def losses(df: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """key, pos, part: where two normal forms differ, paragraph by paragraph; a paragraph that only one has differs in its text."""
    n = F.greatest(F.size(before), F.size(after))
    each = df.where(n > 0).select(key, F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"), before, after).select(key, F.col("pos").cast("long").alias("pos"), F.get(before, F.col("pos")).alias("x"), F.get(after, F.col("pos")).alias("y"))
    x, y = F.col("x"), F.col("y")
    one = x.isNull() | y.isNull()
    marks = lambda c, part: F.regexp_replace(_part(c, part), "\0+", "\0") if part in ("bold", "italic", "suggestion") else _part(c, part)
    found = F.when(one, F.array(F.lit("text"))).otherwise(F.array_compact(F.array(*[F.when(~marks(x, p).eqNullSafe(marks(y, p)), p) for p in PARTS])))
    return each.select(key, "pos", F.explode(found).alias("part"))
