"""Drafts of documents for the merge queries: a base and two edited versions of each, and the SQL that says what their merge must give.

What a side does to a paragraph follows from document and paragraph number, so SQL knows each
paragraph by its number, where the merge has to find it by its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a side does to a paragraph, by a number that (document, paragraph) gives.
DELETE, AMEND, RESTYLE, ASK, INSERT, AGREE = range(6)
CODE = {"ours": "(doc_id * 7 + {i} * 5 + doc_id * {i}) % 19", "theirs": "(doc_id * 11 + {i} * 3 + doc_id * {i} * 2) % 17"}
#: Documents of so many paragraphs, of every third and every fourth document, have their first moved: to the end, or after the middle.
LONG, MOVES = 16, {"ours": 3, "theirs": 4}


def drafts(docs: DataFrame) -> DataFrame:
    """doc_id, base, ours, theirs: lists of paragraphs of text, format and note. A paragraph is a line with its number."""
    paragraph = lambda text, style, note: F.struct(text.alias("text"), style.alias("format"), note.alias("note"))
    numbered = lambda x, i: paragraph(F.concat((i + 1).cast("string"), F.lit(". "), x), F.when(x.endswith("."), "body").otherwise("heading"), F.lit(""))
    base = docs.select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), numbered).alias("base")).withColumn("n", F.size("base"))

    def side(name: str) -> Column:
        # A lambda's variables can't go through SQL text, so the formulas stand here once more.
        def code(i: Column) -> Column:
            d = F.col("doc_id")
            return (d * 7 + i * 5 + d * i) % 19 if name == "ours" else (d * 11 + i * 3 + d * i * 2) % 17

        moves = (F.col("doc_id") % MOVES[name] == 0) & (F.col("n") >= LONG)

        def edited(p: Column, i: Column) -> Column:
            at, first = i.cast("double"), moves & (i == 0)
            own = F.when(first, -1).otherwise(code(i))
            text = F.when(own == AMEND, F.concat(p["text"], F.lit(f" as amended by {name}"))).when(own == AGREE, F.concat(p["text"], F.lit(" as agreed"))).otherwise(p["text"])
            style, note = F.when(own == RESTYLE, f"quoted by {name}").otherwise(p["format"]), F.when(own == ASK, f"{name} asks").otherwise(p["note"])
            place = F.when(first, F.floor(F.col("n") / 2) + 0.7 if name == "theirs" else F.col("n").cast("double")).otherwise(at)
            item = lambda at, p: F.struct(at.alias("at"), p.alias("p"))
            kept = item(place, paragraph(text, style, note))
            new = item(at + 0.5, paragraph(F.concat(F.lit("After "), (i + 1).cast("string"), F.lit(f" inserted by {name}")), F.lit("body"), F.lit("")))
            inserts = (own == INSERT) & (i < F.col("n") - 1) & (code(i + 1) != DELETE)
            return F.when(own == DELETE, F.array().cast("array<struct<at:double,p:struct<text:string,format:string,note:string>>>")).when(inserts, F.array(kept, new)).otherwise(F.array(kept))

        return F.transform(F.array_sort(F.flatten(F.transform("base", edited))), lambda x: x["p"])

    return base.withColumns({s: side(s) for s in ("ours", "theirs")}).select("doc_id", "base", "ours", "theirs")


def _sql_side(name: str, c: str) -> str:
    """Columns of a side, c its letter: moves the first, code, text, format, note, gone, touched, inserts."""
    return f"""
{c}0 AS (SELECT *, doc_id % {MOVES[name]} = 0 AND n >= {LONG} AS {c}_moves, CASE WHEN i = 0 AND doc_id % {MOVES[name]} = 0 AND n >= {LONG} THEN -1 ELSE {CODE[name].format(i='i')} END AS {c}_code FROM {{}}),
{c}1 AS (SELECT *, {c}_moves AND i = 0 AS {c}_moved, {c}_code = {DELETE} AS {c}_gone, {c}_code IN ({AMEND}, {RESTYLE}, {ASK}, {AGREE}) OR ({c}_moves AND i = 0) AS {c}_touched,
  bt || CASE {c}_code WHEN {AMEND} THEN ' as amended by {name}' WHEN {AGREE} THEN ' as agreed' ELSE '' END AS {c}t, CASE {c}_code WHEN {RESTYLE} THEN 'quoted by {name}' ELSE bf END AS {c}f, CASE {c}_code WHEN {ASK} THEN '{name} asks' ELSE '' END AS {c}n,
  {c}_code = {INSERT} AND i < n - 1 AND {CODE[name].format(i='(i + 1)')} <> {DELETE} AS {c}_inserts FROM {c}0),"""


#: r: a row for each base paragraph and each new one, with its kind, choice and what comes of it.
MERGE_SQL = f"""
WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
b AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i, len(lines) AS n FROM x),
b1 AS (SELECT doc_id, i, n, (i + 1) || '. ' || line AS bt, CASE WHEN line LIKE '%.' THEN 'body' ELSE 'heading' END AS bf FROM b),{_sql_side('ours', 'o').format('b1')}{_sql_side('theirs', 't').format('o1')}
a AS (SELECT *, max(CASE WHEN i > 0 AND NOT o_gone THEN i END) OVER (PARTITION BY doc_id) AS o_after, max(CASE WHEN i > 0 AND i <= n // 2 AND NOT t_gone THEN i END) OVER (PARTITION BY doc_id) AS t_after FROM t1),
k AS (SELECT *, CASE WHEN (o_gone AND NOT t_gone AND t_touched) OR (t_gone AND NOT o_gone AND o_touched) OR (o_moved AND t_moved) THEN 'structural'
  WHEN o_gone OR t_gone THEN NULL WHEN ot <> bt AND tt <> bt AND ot <> tt THEN 'text' WHEN "of" <> bf AND tf <> bf AND "of" <> tf THEN 'formatting' WHEN "on" <> '' AND tn <> '' AND "on" <> tn THEN 'metadata' END AS kind FROM a),
c AS (SELECT *, CASE WHEN kind IS NULL OR (o_moved AND t_moved) THEN NULL WHEN o_gone OR t_gone THEN 'edit' WHEN length(ot) >= length(tt) THEN 'ours' ELSE 'theirs' END AS choice FROM k),
m AS (SELECT *, choice = 'edit' AS restored, (o_gone OR t_gone) AND kind IS NULL AS dropped FROM c),
r AS (SELECT doc_id, i AS anchor, false AS added, kind, choice, bt, CASE WHEN NOT o_gone THEN ot END AS ot, CASE WHEN NOT t_gone THEN tt END AS tt,
  CASE WHEN dropped OR (kind IS NOT NULL AND choice IS NULL) THEN NULL WHEN choice = 'edit' THEN bt WHEN ot = tt OR tt = bt THEN ot WHEN ot = bt THEN tt WHEN choice = 'ours' THEN ot ELSE tt END AS merged,
  CASE WHEN dropped THEN NULL WHEN choice = 'edit' THEN bf WHEN "of" = tf OR tf = bf THEN "of" WHEN "of" = bf THEN tf WHEN choice = 'ours' THEN "of" ELSE tf END AS format,
  CASE WHEN dropped THEN NULL WHEN choice = 'edit' THEN '' WHEN "on" = tn OR tn = '' THEN "on" WHEN "on" = '' THEN tn WHEN choice = 'ours' THEN "on" ELSE tn END AS note, NOT dropped AS kept,
  CASE WHEN restored THEN i WHEN o_moved THEN o_after WHEN t_moved THEN t_after ELSE i END AS p1, CASE WHEN restored THEN 0 WHEN o_moved THEN 1 WHEN t_moved THEN 2 ELSE 0 END AS p2, CASE WHEN o_moved OR t_moved THEN 2 ELSE 0 END AS p3,
  o_gone OR o_touched AS ours_touched, t_gone OR t_touched AS theirs_touched FROM m
  UNION ALL SELECT doc_id, i, true, NULL, NULL, NULL, new, NULL, new, 'body', '', true, i, 1, 1, true, false FROM (SELECT *, 'After ' || (i + 1) || ' inserted by ours' AS new FROM m WHERE o_inserts)
  UNION ALL SELECT doc_id, i, true, NULL, NULL, NULL, NULL, new, new, 'body', '', true, i, 2, 1, false, true FROM (SELECT *, 'After ' || (i + 1) || ' inserted by theirs' AS new FROM m WHERE t_inserts))
"""


# Documents with marks, for the conversions ---------------------------------------------------------


def marked_up(docs: DataFrame) -> DataFrame:
    """doc_id, paragraphs: a line is a paragraph, a heading if it has no full stop, with bold and italic first words, suggestions and comments by its number."""
    def paragraph(x: Column, i: Column) -> Column:
        head = F.substring_index(x, " ", 1)
        run = lambda text, bold, italic, suggested: F.struct(text.alias("text"), bold.alias("bold"), italic.alias("italic"), suggested.alias("suggested"))
        first = run(head, i % 3 == 0, i % 5 == 0, F.lit(""))
        rest = run(F.substring(x, F.length(head) + 1, F.length(x)), F.lit(False), F.lit(False), F.when(i % 7 == 3, "ins").otherwise(""))
        style = F.when(x.endswith("."), "NORMAL_TEXT").otherwise(F.concat(F.lit("HEADING_"), (1 + i % 6).cast("string")))
        note = F.array(F.struct(F.lit("reviewer|a").alias("author"), F.substring(x, 1, 20).alias("content")))
        return F.struct(style.alias("style"), F.array(first, rest).alias("runs"), F.when(i % 11 == 5, note).otherwise(F.array().cast("array<struct<author:string,content:string>>")).alias("comments"))

    return docs.select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), paragraph).alias("paragraphs"))


#: p: what a conversion to text alone loses of each paragraph (of an empty text, the paragraph itself).
LOSSES_SQL = """
WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i, len(lines) AS n FROM x),
h AS (SELECT *, split_part(line, ' ', 1) AS head FROM l),
p AS (SELECT doc_id, i AS pos, unnest(CASE WHEN n = 1 AND line = '' THEN ['text'] ELSE list_filter([CASE WHEN line NOT LIKE '%.' THEN 'style' END, CASE WHEN i % 3 = 0 AND head <> '' THEN 'bold' END, CASE WHEN i % 5 = 0 AND head <> '' THEN 'italic' END,
  CASE WHEN i % 7 = 3 AND head <> line THEN 'suggestion' END, CASE WHEN i % 11 = 5 THEN 'comment' END], lambda y: y IS NOT NULL) END) AS part FROM h)
"""
