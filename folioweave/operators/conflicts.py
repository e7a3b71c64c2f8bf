"""Conflicts of two versions against their base, their resolution, and differences of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.alignment import differences, with_places

#: Lines that mark the two sides of a conflict.
OURS, BETWEEN, THEIRS = "<<<<<<< ours", "=======", ">>>>>>> theirs"
SIDES = ("base", "ours", "theirs")


def versions_of(turns: DataFrame) -> DataFrame:
    """conv_id, base, ours, theirs: lists of paragraphs of turns 0, 1 and 2; a conversation without turn 0 has an empty base.

    A paragraph is a line. One without a full stop is a heading; what stands in parentheses is its note.
    """
    paragraph = lambda x: F.struct(x.alias("text"), F.when(x.endswith("."), "body").otherwise("heading").alias("format"), F.regexp_extract(x, r"\(([^)]*)\)", 1).alias("note"))
    each = turns.where("turn <= 2").select("conv_id", "turn", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), paragraph).alias("p"))
    return each.groupBy("conv_id").agg(*[F.coalesce(F.max_by("p", F.when(F.col("turn") == k, 1)), F.array().cast(each.schema["p"].dataType)).alias(s) for k, s in enumerate(SIDES)])


def paragraphs(turns: DataFrame) -> DataFrame:
    """What aligned() gives of turns 0, 1 and 2 of each conversation."""
    return aligned(versions_of(turns), "conv_id")


def aligned(versions: DataFrame, key: str) -> DataFrame:
    """key, anchor, added, base, ours, theirs: the paragraphs of three versions, lists of text, format and note, side by side.

    Each side is aligned with the base by its texts (see alignment.align). A base paragraph stands at its number, ``anchor``,
    with what either side has of it; a new one (``added``) at the base paragraph it follows, or -1. Both
    sides' new paragraphs of the same text at the same place are one. Beside its parts each
    side has ``moved``, ``after`` and ``nth``, which say where it stands. Null lists are empty ones.
    """
    texts = {f"{s}_texts": F.transform(F.coalesce(F.col(s), F.array().cast(versions.schema[s].dataType)), lambda x: x["text"]) for s in SIDES}
    placed = with_places(versions.select(key, *SIDES).withColumns(texts), "base_texts", "ours_texts", "theirs_texts")
    parts = lambda p, at: F.struct(p["text"].alias("text"), p["format"].alias("format"), p["note"].alias("note"), at["moved"].alias("moved"), at["after"].alias("after"), at["nth"].alias("nth"))
    stays = lambda i: F.struct(F.lit(False).alias("moved"), i.alias("after"), F.lit(0).alias("nth"))
    row = lambda anchor, added, new, twin, side, p: F.struct(anchor.alias("anchor"), added.alias("added"), new.alias("new"), twin.alias("twin"), F.lit(side).alias("side"), p.alias("p"))
    every = [F.transform("base", lambda p, i: row(i, F.lit(False), F.lit(""), F.lit(0), 0, parts(p, stays(i))))]
    for k, s in enumerate(SIDES[1:], 1):

        def of_side(x: Column) -> Column:
            at, added = x["at"], x["at"]["at"] < 0
            return row(F.when(added, at["after"]).otherwise(at["at"]), added, F.when(added, x["p"]["text"]).otherwise(""), F.when(added, at["twin"]).otherwise(0), k, parts(x["p"], at))  # noqa: B023

        every.append(F.transform(F.arrays_zip(F.col(s).alias("p"), F.col(f"{s}_texts_places").alias("at")), of_side))
    # All three sides leave the one pass that aligns them; a branch for each would align them three times.
    rows = placed.select(key, F.explode(F.concat(*[F.coalesce(x, F.array()) for x in every])).alias("row")).select(key, "row.*")
    sides = [F.max(F.when(F.col("side") == k, F.col("p"))).alias(s) for k, s in enumerate(SIDES)]
    return rows.groupBy(key, "anchor", "added", "new", "twin").agg(*sides).select(key, F.col("anchor").cast("long").alias("anchor"), "added", *SIDES)


def with_kind(sides: DataFrame) -> DataFrame:
    """Adds kinds, all conflicts of a paragraph, and kind, the first of them: structural, text, formatting, metadata.

    Each is a part that both sides changed, and not to the same: a paragraph deleted by one and
    changed or moved by the other, or moved to different places; its text; its format; its note.
    What both add, in the same place, is no conflict: both are kept.
    """
    b, o, t = (F.col(s) for s in SIDES)
    clash = lambda f: ~o[f].eqNullSafe(b[f]) & ~t[f].eqNullSafe(b[f]) & ~o[f].eqNullSafe(t[f])
    touched = lambda x: ~x["text"].eqNullSafe(b["text"]) | ~x["format"].eqNullSafe(b["format"]) | ~x["note"].eqNullSafe(b["note"]) | x["moved"]
    gone = (o.isNull() & t.isNotNull() & touched(t)) | (t.isNull() & o.isNotNull() & touched(o))
    apart = o["moved"] & t["moved"] & (o["after"] != t["after"])
    both = o.isNotNull() & t.isNotNull()
    found = [F.when(gone | apart, "structural"), *[F.when(both & clash(f), k) for f, k in (("text", "text"), ("format", "formatting"), ("note", "metadata"))]]
    kinds = F.when(b.isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*found)))
    return sides.withColumn("kinds", kinds).withColumn("kind", F.get("kinds", F.lit(0)))


def merged(sides: DataFrame) -> DataFrame:
    """Adds merged (its text), format, note, kept and order to paragraphs with their kinds.

    Of each part the result has what one side changed, where both did what ``choice`` says:
    ours, theirs, or edit (then column edit is the text, and the rest is the base's). Without a
    choice a conflict stays open: its text is null. ``kept`` says whether the paragraph is in
    the result, ``order`` where.
    """
    b, o, t, choice = (F.col(s) for s in (*SIDES, "choice"))
    ours, theirs, edited = (choice.eqNullSafe(c) for c in ("ours", "theirs", "edit"))
    clash, structural = F.size("kinds") > 0, F.array_contains("kinds", "structural")
    added, gone = b.isNull(), b.isNotNull() & (o.isNull() | t.isNull())
    picked = F.when(ours, o).when(theirs, t).when(edited, b)

    def part(f: str) -> Column:
        one = F.when(o[f].eqNullSafe(t[f]) | t[f].eqNullSafe(b[f]), o[f]).when(o[f].eqNullSafe(b[f]), t[f]).otherwise(picked[f])
        return F.when(added, F.coalesce(o, t)[f]).when(gone, picked[f]).otherwise(one)

    place = lambda x, rank: F.struct(x["after"].alias("after"), F.lit(rank).alias("rank"), x["nth"].alias("nth"))
    by_ours, by_theirs = (x.isNotNull() & (added | x["moved"]) for x in (o, t))
    order = F.when(by_theirs & (theirs | ~by_ours), place(t, 2)).when(by_ours, place(o, 1)).otherwise(place(b, 0))
    return sides.withColumns({
        "merged": F.when(clash & choice.isNull(), None).when(clash & edited, F.col("edit")).otherwise(part("text")),
        "format": part("format"), "note": part("note"),
        "kept": F.when(gone, structural & (choice.isNull() | picked.isNotNull())).otherwise(added | o.isNotNull()),
        "order": F.when(structural & edited, place(b, 0)).otherwise(order),
    })


def merged_texts(paragraphs: DataFrame, key: str) -> DataFrame:
    """key, text, n_open: the merged paragraphs in order, a line each; open conflicts stand as marker lines."""
    line = F.when((F.size("kinds") > 0) & F.col("choice").isNull(), _markers()).otherwise(F.col("merged"))
    at = F.when(F.col("kept"), F.struct("order", line.alias("line")))
    found = paragraphs.groupBy(key).agg(F.sort_array(F.collect_list(at)).alias("lines"), F.count_if((F.size("kinds") > 0) & F.col("choice").isNull()).alias("n_open"))
    return found.select(key, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"), "n_open")


def undecided(sides: DataFrame) -> DataFrame:
    """No choice for any conflict."""
    return sides.withColumns({"choice": F.lit(None).cast("string"), "edit": F.lit(None).cast("string")})


def chosen_by_length(sides: DataFrame) -> DataFrame:
    """Chooses the side of the longer text; where one deleted the paragraph, an edit that restores the base's.

    Where both moved it to different places, length says nothing: that stays open.
    """
    o, t = F.length(F.col("ours")["text"]), F.length(F.col("theirs")["text"])
    choice = F.when(o.isNull() | t.isNull(), "edit").when(F.array_contains("kinds", "structural"), None).when(o >= t, "ours").otherwise("theirs")
    return sides.withColumns({"choice": F.when(F.size("kinds") > 0, choice), "edit": F.col("base")["text"]})


def history(resolved: DataFrame, key: str = "conv_id") -> DataFrame:
    """An append-only record of each conflict, keyed by hashes of its three sides, with the choice made."""
    digest = lambda s: F.md5(F.coalesce(F.col(s)["text"], F.lit("")))
    return resolved.where("size(kinds) > 0").select(key, "anchor", F.explode("kinds").alias("kind"), *[digest(s).alias(f"{s}_md5") for s in SIDES], "choice", F.md5(F.coalesce("merged", F.lit(""))).alias("merged_md5"))


def _markers() -> Column:
    o, t = (F.coalesce(F.col(s)["text"], F.lit("")) for s in ("ours", "theirs"))
    return F.concat_ws("\n", F.lit(OURS), o, F.lit(BETWEEN), t, F.lit(THEIRS))


def marked(sides: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, anchor, marked: conflicts as raw marker text."""
    return sides.where("size(kinds) > 0").select(key, "anchor", _markers().alias("marked"))


def unmarked(texts: DataFrame, key: str = "conv_id") -> DataFrame:
    """Marker text back to its two sides."""
    pattern = rf"(?s)^{OURS}\n(.*)\n{BETWEEN}\n(.*)\n{THEIRS}$"
    return texts.select(key, "anchor", F.regexp_extract("marked", pattern, 1).alias("ours"), F.regexp_extract("marked", pattern, 2).alias("theirs"))


def settled(text: Column) -> Column:
    """Text in which white space and case don't count."""
    return F.lower(F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " ")))


def change_kinds(versions: DataFrame, numstat: DataFrame, least: int = 3) -> DataFrame:
    """conv_id, turn, format_only, substantial for each version after the first.

    Format only: same words, other case or white space. Substantial: ``least`` added and removed lines or more.
    """
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = versions.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).withColumn("old", before).where("old is not null")
    same = (settled(F.col("text")) == settled(F.col("old"))) & (F.col("text") != F.col("old"))
    return pairs.select("conv_id", "turn", same.alias("format_only")).join(numstat, ["conv_id", "turn"]).select("conv_id", "turn", "format_only", (F.col("additions") + F.col("deletions") >= least).alias("substantial"))


def ordered_diff(versions: DataFrame) -> DataFrame:
    """conv_id, turn, pos, op, line: each version's shortest line difference from the one before, in order."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    lines = lambda c: F.split(F.coalesce(c, F.lit("")), "\n")
    pairs = versions.select("conv_id", "turn", "text", before.alias("old")).where("turn > 0")
    return differences(pairs.select("conv_id", "turn", lines(F.col("old")).alias("old"), lines(F.col("text")).alias("new")), "old", "new")
