"""Queries over commit records, the commit graph, conflicts and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import masked
from ..operators import conflicts, records, retention, versions
from ..session import new_folder
from .drafts import MERGE_SQL, drafts
from .registry import on

_TYPE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'fix' WHEN '2-HIGH' THEN 'feat' WHEN '3-MEDIUM' THEN 'review' WHEN '4-NOT SPECIFIED' THEN 'draft' WHEN '5-LOW' THEN 'format' ELSE 'other' END"
_RECORD = f"""
WITH f AS (SELECT l_orderkey, 'clause-' || l_partkey || '.md' AS path, CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'R' THEN 'removed' ELSE 'modified' END AS status, CAST(l_quantity AS INTEGER) AS additions, CAST(l_linenumber AS INTEGER) AS deletions FROM lineitem),
g AS (SELECT l_orderkey, count(*) AS n_files, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions, coalesce(array_to_string(list_sort(list(DISTINCT path) FILTER (status = 'added')), ','), '') AS added,
  coalesce(array_to_string(list_sort(list(DISTINCT path) FILTER (status = 'removed')), ','), '') AS removed, array_to_string(list_sort(list(DISTINCT 'section-' || deletions)), ',') AS sections FROM f GROUP BY 1),
r AS (SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) AS hash, CASE o_orderstatus WHEN 'O' THEN {_TYPE} || ': update clause ' || o_orderkey WHEN 'P' THEN 'Updated clause ' || o_orderkey
  ELSE {_TYPE} || ': accept every remaining change of the other side in clause ' || o_orderkey END AS message, CAST(o_custkey AS VARCHAR) AS author, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS ts FROM orders)
"""
on("commit_records", "orders lineitem", lambda o, f: records.summary(records.records(o, f)), _RECORD + "SELECT hash, substring(hash, 1, 14) AS short_hash, message, author, ts, coalesce(n_files, 0) AS n_files, coalesce(additions, 0) AS additions, coalesce(deletions, 0) AS deletions, coalesce(added, '') AS added, coalesce(removed, '') AS removed, coalesce(sections, '') AS sections FROM r LEFT JOIN g ON l_orderkey = o_orderkey")
on("commit_files", "orders lineitem", lambda o, f: records.flat_files(records.records(o, f)), _RECORD + "SELECT hash, path, status, additions, deletions FROM f JOIN r ON o_orderkey = l_orderkey")
on("files_modified", "lineitem", lambda f: records.modified_paths(records.changed_files(f)), _RECORD + "SELECT path, count(*) AS n, CAST(sum(additions) AS BIGINT) AS additions FROM f WHERE status = 'modified' GROUP BY 1")
on("commit_index_text", "orders lineitem", lambda o, f: records.embed_text(records.records(o, f)).select("hash", "message", "embed_text"), _RECORD + """
SELECT hash, message, concat_ws(' ', message, array_to_string(list_concat(list_transform(CASE WHEN coalesce(removed, '') = '' THEN [] ELSE string_split(removed, ',') END, lambda x: '-' || x), list_transform(CASE WHEN coalesce(added, '') = '' THEN [] ELSE string_split(added, ',') END, lambda x: '+' || x)), ' ')) AS embed_text
FROM r LEFT JOIN g ON l_orderkey = o_orderkey""")
on("commit_metadata", "orders", records.captured, "SELECT o_orderkey, o_custkey AS author, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS ts, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders")
on("timestamp_formats", "orders", records.shown_times, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, date_trunc('second', o_orderdate) AS parsed, strftime(o_orderdate, '%Y-%m-%d %I:%M %p') AS shown FROM orders")

_PARENTS = """
WITH RECURSIVE o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS t, o_orderstatus AS s, lag(o_orderkey) OVER w AS p1,
  last_value(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p2
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
e AS (SELECT k AS child, p1 AS parent FROM o WHERE p1 IS NOT NULL UNION SELECT k, p2 FROM o WHERE s = 'F' AND p2 IS NOT NULL),
r AS (SELECT child, parent AS ancestor, CAST(1 AS BIGINT) AS distance FROM e UNION SELECT r.child, e.parent, r.distance + 1 FROM r JOIN e ON e.child = r.ancestor),
a AS (SELECT child, ancestor, min(distance) AS distance FROM r GROUP BY ALL)
"""
on("commit_parents", "orders", records.parents, _PARENTS + "SELECT child, parent FROM e")
on("commit_ancestry", "orders", lambda o: records.ancestry(records.parents(o)), _PARENTS + "SELECT child, ancestor, distance FROM a")
on("merge_bases", "orders", lambda o: records.merge_bases(records.heads(o), records.parents(o)), _PARENTS + """,
h AS (SELECT c, arg_max(k, (t, k)) FILTER (s = 'O') AS a, arg_max(k, (t, k)) FILTER (s = 'P') AS b FROM o GROUP BY c HAVING count(*) FILTER (s = 'O') > 0 AND count(*) FILTER (s = 'P') > 0),
z AS (SELECT child, ancestor, distance FROM a UNION ALL SELECT k, k, 0 FROM o),
m AS (SELECT h.a, h.b, x.ancestor AS base, x.distance + y.distance AS steps FROM h JOIN z x ON x.child = h.a JOIN z y ON y.child = h.b AND y.ancestor = x.ancestor)
SELECT h.a, h.b, base, steps FROM h LEFT JOIN (SELECT a, b, base, steps, row_number() OVER (PARTITION BY a, b ORDER BY steps, base) AS n FROM m QUALIFY n = 1) q ON q.a = h.a AND q.b = h.b""")

# Conflicts -----------------------------------------------------------------


def _kinds(d: DataFrame) -> DataFrame:
    return conflicts.with_kind(conflicts.aligned(drafts(d), "doc_id"))


def _merged(d: DataFrame) -> DataFrame:
    return conflicts.merged(conflicts.chosen_by_length(_kinds(d)))


def _both_touched(d: DataFrame) -> DataFrame:
    rows = conflicts.aligned(drafts(d), "doc_id").where("not added")
    touched = lambda s: ~F.col(f"{s}.text").eqNullSafe(F.col("base.text")) | ~F.col(f"{s}.format").eqNullSafe(F.col("base.format")) | ~F.col(f"{s}.note").eqNullSafe(F.col("base.note")) | F.col(f"{s}.moved")
    return rows.where(touched("ours") & touched("theirs")).select("doc_id", "anchor")


_MARKED = "'<<<<<<< ours' || chr(10) || coalesce(ot, '') || chr(10) || '=======' || chr(10) || coalesce(tt, '') || chr(10) || '>>>>>>> theirs'"
on("conflict_kinds", "documents", lambda d: _kinds(d).select("doc_id", "anchor", "added", "kind"), MERGE_SQL + "SELECT doc_id, anchor, added, kind FROM r")
on("conflict_resolution", "documents", lambda d: _merged(d).select("doc_id", "anchor", "kind", "choice", "merged", "format", "note", "kept"), MERGE_SQL + "SELECT doc_id, anchor, kind, choice, merged, format, note, kept FROM r")
on("conflict_merged_texts", "documents", lambda d: conflicts.merged_texts(_merged(d), "doc_id").select("doc_id", F.md5("text").alias("text_md5"), "n_open"), MERGE_SQL + f"""
SELECT doc_id, md5(coalesce(string_agg(CASE WHEN kind IS NOT NULL AND choice IS NULL THEN {_MARKED} ELSE merged END, chr(10) ORDER BY p1, p2, p3) FILTER (kept), '')) AS text_md5, count(*) FILTER (kind IS NOT NULL AND choice IS NULL) AS n_open FROM r GROUP BY 1""")
on("conflict_history", "documents", lambda d: conflicts.history(_merged(d), "doc_id"), MERGE_SQL + "SELECT doc_id, anchor, kind, md5(coalesce(bt, '')) AS base_md5, md5(coalesce(ot, '')) AS ours_md5, md5(coalesce(tt, '')) AS theirs_md5, choice, md5(coalesce(merged, '')) AS merged_md5 FROM r WHERE kind IS NOT NULL")
on("conflict_markers", "documents", lambda d: conflicts.marked(_kinds(d), "doc_id"), MERGE_SQL + f"SELECT doc_id, anchor, {_MARKED} AS marked FROM r WHERE kind IS NOT NULL")
on("conflict_markers_split", "documents", lambda d: conflicts.unmarked(conflicts.marked(_kinds(d), "doc_id"), "doc_id"), MERGE_SQL + "SELECT doc_id, anchor, coalesce(ot, '') AS ours, coalesce(tt, '') AS theirs FROM r WHERE kind IS NOT NULL")
on("conflict_success", "documents", lambda d: _merged(d).where("kind is not null").groupBy("kind").agg(F.round(F.count("choice") / F.count("*"), 6).alias("rate")), MERGE_SQL + "SELECT kind, round(count(choice) / count(*), 6) AS rate FROM r WHERE kind IS NOT NULL GROUP BY 1")
# Both sides begin with the base's text, so the distance is that of what follows it; -1 would be over 100.
on("conflict_distance", "documents", lambda d: _kinds(d).where("kind = 'text'").select("doc_id", "anchor", F.levenshtein("ours.text", "theirs.text", 100).cast("long").alias("distance")), MERGE_SQL + "SELECT doc_id, anchor, levenshtein(substring(ot, length(bt) + 1), substring(tt, length(bt) + 1)) AS distance FROM r WHERE kind = 'text'")
on("sections_both_touched", "documents", _both_touched, MERGE_SQL + "SELECT doc_id, anchor FROM r WHERE NOT added AND ours_touched AND theirs_touched")
on("change_kinds", "conversations", lambda c: conflicts.change_kinds(c, versions.numstat(c)), """
WITH l AS (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM conversations), c AS (SELECT conv_id, turn, line, count(*) AS n FROM l GROUP BY ALL), v AS (SELECT DISTINCT conv_id, turn FROM conversations),
m AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn + 1) AS turn, abs(coalesce(a.n, 0) - coalesce(b.n, 0)) AS d
  FROM c a FULL JOIN (SELECT c.* FROM c JOIN v ON v.conv_id = c.conv_id AND v.turn = c.turn + 1) b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 AND a.line = b.line),
s AS (SELECT conv_id, turn, sum(d) AS d FROM m GROUP BY ALL),
t AS (SELECT conv_id, turn, coalesce(text, '') AS x, lag(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS y FROM conversations)
SELECT conv_id, turn, lower(trim(regexp_replace(x, '[ \\t\\r\\n]+', ' ', 'g'))) = lower(trim(regexp_replace(y, '[ \\t\\r\\n]+', ' ', 'g'))) AND x <> y AS format_only, d >= 3 AS substantial FROM t JOIN s USING (conv_id, turn) WHERE y IS NOT NULL""")
on("ordered_diff", "conversations", conflicts.ordered_diff)  # tests apply each difference to the old text
on("history_rewrite", "conversations", lambda c: versions.hash_links(c.withColumn("text", masked(F.col("text")))), """
SELECT conv_id, turn, sha256(coalesce(lag(own) OVER (PARTITION BY conv_id ORDER BY turn), '') || own) AS link FROM (SELECT conv_id, turn, sha256(coalesce(regexp_replace(regexp_replace(regexp_replace(text,
  '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}', '[EMAIL]', 'g'), '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}', '[IP]', 'g'), '[0-9]{3}-[0-9]{2}-[0-9]{4}', '[SSN]', 'g'), '')) AS own FROM conversations)""")


def _deleted(o: DataFrame, c: DataFrame) -> DataFrame:
    """The orders' history after customers in debt asked for deletion, by a rewrite of the files that hold them."""
    spark, path, schema = o.sparkSession, new_folder(o.sparkSession, "history"), "o_orderkey long, o_custkey long"
    retention.append(o.select("o_orderkey", "o_custkey"), path, "o_custkey")
    retention.delete(spark, path, schema, c.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    return retention.current(spark, path, schema)


on("deletion_rewrite", "orders customer", _deleted, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
on("changed_documents", "conversations", lambda c: versions.added(c).where("turn > 0").select("conv_id").union(versions.removed(c).where("turn > 0").select("conv_id")).distinct(), """
WITH t AS (SELECT conv_id, turn, list_sort(string_split(coalesce(text, ''), chr(10))) AS x FROM conversations)
SELECT DISTINCT a.conv_id FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND a.x <> b.x""")
