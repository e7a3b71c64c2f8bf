"""Every query by name: what it reads, the operator it applies, and the same in standard SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql
from ..operators import access, activity, commits, documents, versions
from ..session import table
from ..streaming import replay
from . import history, references, reports  # noqa: F401  their queries register themselves
from .registry import on, oracle_sql, queries, query, streamed  # noqa: F401

# Versions ------------------------------------------------------------------

_COUNTS = """
WITH l AS (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM conversations),
c AS (SELECT conv_id, turn, line, count(*) AS n FROM l GROUP BY ALL),
v AS (SELECT DISTINCT conv_id, turn FROM conversations),
m AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn + 1) AS turn, coalesce(a.line, b.line) AS line,
             coalesce(a.n, 0) AS cur, coalesce(b.n, 0) AS prev
      FROM c a FULL JOIN (SELECT c.* FROM c JOIN v ON v.conv_id = c.conv_id AND v.turn = c.turn + 1) b
        ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 AND a.line = b.line)
"""
on("version_numstat", "conversations", versions.numstat, _COUNTS + "SELECT conv_id, turn, CAST(sum(greatest(cur - prev, 0)) AS BIGINT) AS additions, CAST(sum(greatest(prev - cur, 0)) AS BIGINT) AS deletions FROM m GROUP BY ALL")
on("version_lines_added", "conversations", versions.added, _COUNTS + "SELECT conv_id, turn, line, cur - prev AS n FROM m WHERE cur > prev")
on("version_lines_removed", "conversations", versions.removed, _COUNTS + "SELECT conv_id, turn, line, prev - cur AS n FROM m WHERE prev > cur")
on("version_lines_kept", "conversations", versions.kept, _COUNTS + "SELECT conv_id, turn, CAST(sum(least(cur, prev)) AS BIGINT) AS n_kept FROM m GROUP BY ALL")
on("blame_surviving_lines", "conversations", versions.blame, """
WITH l AS (SELECT DISTINCT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM conversations),
i AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id, line ORDER BY turn) AS island FROM l),
r AS (SELECT conv_id, line, min(turn) AS first_turn, max(turn) AS final FROM i GROUP BY conv_id, line, island)
SELECT r.conv_id, line, first_turn FROM r JOIN (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1) e ON e.conv_id = r.conv_id AND final = last""")
on("version_latest", "conversations", versions.latest, "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
on("restore_at_turn", "conversations", lambda c: versions.latest(c, at=2), "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE turn <= 2 GROUP BY conv_id")
on("hash_chain", "conversations", versions.hash_links, """
SELECT conv_id, turn, sha256(coalesce(lag(own) OVER (PARTITION BY conv_id ORDER BY turn), '') || own) AS link
FROM (SELECT conv_id, turn, sha256(coalesce(text, '')) AS own FROM conversations)""")


def _turn(c: DataFrame, n: int) -> DataFrame:
    return versions.lines(c.where(F.col("turn") == n)).select("conv_id", "line")


on("merge_three_way", "conversations", lambda c: versions.three_way_merge(_turn(c, 0), _turn(c, 1), _turn(c, 2)), """
WITH l AS (SELECT DISTINCT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM conversations WHERE turn <= 2),
s AS (SELECT conv_id, line, bool_or(turn = 0) AS b, bool_or(turn = 1) AS o, bool_or(turn = 2) AS t FROM l GROUP BY ALL)
SELECT conv_id, line, CASE WHEN b AND o AND t THEN 'kept' WHEN b AND o THEN 'removed_theirs' WHEN b AND t THEN 'removed_ours' WHEN b THEN 'removed_both'
  WHEN o AND t THEN 'added_both' WHEN o THEN 'added_ours' ELSE 'added_theirs' END AS status FROM s""")

# Commits -------------------------------------------------------------------

_TYPE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'fix' WHEN '2-HIGH' THEN 'feat' WHEN '3-MEDIUM' THEN 'review' WHEN '4-NOT SPECIFIED' THEN 'draft' WHEN '5-LOW' THEN 'format' ELSE 'other' END"
_TIME = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
on("version_timeline", "orders", commits.timeline, f"SELECT o_custkey, o_orderkey, row_number() OVER ({_TIME}) AS episode FROM orders")
on("commit_file_totals", "orders lineitem", commits.file_totals, """
SELECT o_orderkey, coalesce(a, 0) AS additions, coalesce(n, 0) AS n_files FROM orders LEFT JOIN
(SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS a, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
on("commit_change_arrays", "lineitem", commits.change_arrays, "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS paths FROM lineitem GROUP BY 1")
on("commit_gap", "orders", commits.gaps, f"SELECT o_custkey, o_orderkey, date_diff('second', o_orderdate, lead(o_orderdate) OVER ({_TIME})) AS gap_seconds FROM orders")
on("commit_velocity_7d", "orders", commits.velocity, "SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS n_7d FROM orders")
on("commit_weekly_rate", "orders", commits.weekly_rate, "SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week, round(count(*) / count(DISTINCT o_custkey), 4) AS avg_commits FROM orders GROUP BY 1")
on("commit_type_pivot", "orders", commits.type_pivot, "SELECT o_custkey, " + ", ".join(f"count(*) FILTER (t = '{t}') AS {t}" for t in ("draft", "feat", "fix", "format", "review")) + f" FROM (SELECT *, {_TYPE} AS t FROM orders) GROUP BY 1")
on("commit_type_lookup", "orders", commits.type_lookup, f"SELECT t AS type, d AS description, count(*) AS n FROM (SELECT {_TYPE} AS t FROM orders) JOIN (VALUES ('draft', 'first wording'), ('review', 'comments taken in'), ('feat', 'new clauses'), ('fix', 'corrected wording'), ('format', 'layout changes only')) x(k, d) ON t = k GROUP BY ALL")
_MESSAGE = f"""
WITH m AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN {_TYPE} || ': update clause ' || o_orderkey WHEN 'P' THEN 'Updated clause ' || o_orderkey
  ELSE {_TYPE} || ': accept every remaining change of the other side in clause ' || o_orderkey END AS message FROM orders)
"""


def _validity_by_sql(o: DataFrame) -> DataFrame:
    spark = o.sparkSession
    sql.register(spark)
    return spark.sql("SELECT o_orderkey, message, message_type(message) AS type, message_is_valid(message) AS is_valid FROM {m}", m=commits.messages(o))


_VALIDITY = _MESSAGE + """
SELECT o_orderkey, message, regexp_extract(message, '^([a-z]+): \\S', 1) AS type,
  regexp_extract(message, '^([a-z]+): \\S', 1) IN ('feat', 'fix', 'review', 'draft', 'final', 'docs', 'redact', 'merge', 'revert', 'comment', 'cite', 'format') AND length(message) < 50 AS is_valid FROM m"""
on("message_validity", "orders", lambda o: commits.validity(commits.messages(o)), _VALIDITY)
on("message_validity_sql", "orders", _validity_by_sql, _VALIDITY)
on("message_patterns_topk", "orders", lambda o: commits.pattern_top(commits.messages(o)), _MESSAGE + "SELECT regexp_replace(message, '[0-9]+', '#', 'g') AS pattern, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, pattern LIMIT 10")
on("post_signature_amendments", "orders", commits.amendments, f"SELECT o_custkey, o_orderkey, coalesce(bool_or(o_orderstatus = 'F') OVER ({_TIME} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS is_amendment FROM orders")
on("signature_without_review", "orders", commits.signed_without_review, "SELECT o_orderkey FROM orders a WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'P' AND b.o_orderdate < a.o_orderdate)")
on("signature_trail", "orders", commits.signature_trail, f"""
SELECT o_custkey, o_orderkey, o_orderdate AS ts, CASE o_orderstatus WHEN 'F' THEN 'signature' WHEN 'P' THEN 'review' ELSE 'draft' END AS kind, row_number() OVER ({_TIME}) AS place,
  last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END IGNORE NULLS) OVER ({_TIME} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS amends FROM orders WHERE o_orderstatus IN ('F', 'P', 'O')""")
on("history_union", "orders", lambda o: o.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("main").alias("branch")).unionByName(o.where("o_orderstatus <> 'F'").select("o_orderkey", F.lit("work").alias("branch"))), "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'main' ELSE 'work' END AS branch FROM orders WHERE o_orderstatus IS NOT NULL")
on("retention_keep_n", "orders", commits.keep_last, "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 3")
on("retention_cutoff", "orders", lambda o: o.where("o_orderdate >= timestamp_ntz'1996-01-01 00:00:00'").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
on("deletion_rewrite", "orders customer", lambda o, c: commits.without(o, c.where("c_mktsegment = 'BUILDING'")).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")

# Access --------------------------------------------------------------------

_ROLE = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'maintainer' WHEN 'BUILDING' THEN 'developer' WHEN 'FURNITURE' THEN 'reporter' ELSE 'guest' END"
on("role_mapping", "customer", access.roles, f"SELECT c_custkey, {_ROLE} AS role FROM customer")
on("role_unmapped", "customer", access.unmapped, "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IS NULL OR c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD') GROUP BY 1")
on("access_semi", "customer orders", lambda c, o: c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
on("access_anti", "customer orders", lambda c, o: c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey"), "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
on("folder_ancestors", "region nation customer", lambda r, n, c: access.ancestors(access.folder_edges(r, n, c)), """
WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
a AS (SELECT node, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT a.node, e.parent, depth + 1 FROM a JOIN e ON e.node = a.ancestor)
SELECT node, ancestor, depth FROM a""")
on("effective_role", "customer nation", access.effective_rank, f"SELECT c_custkey, CAST(greatest(CASE {_ROLE} WHEN 'maintainer' THEN 4 WHEN 'developer' THEN 3 WHEN 'reporter' THEN 2 ELSE 1 END, coalesce(n_nationkey % 4 + 1, 0)) AS BIGINT) AS role_rank FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")


@query(f"""
WITH d AS (SELECT c_custkey, {_ROLE} AS role FROM customer), g AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'guest' ELSE role END AS role FROM d)
SELECT 'drive' AS side, * FROM (SELECT * FROM d EXCEPT ALL SELECT * FROM g) UNION ALL SELECT 'git', * FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM d)""")
def permission_drift(spark: SparkSession, d: str) -> DataFrame:
    drive = access.roles(table(spark, d, "customer"))
    git = drive.withColumn("role", F.when(F.col("c_custkey") % 7 == 0, "guest").otherwise(F.col("role")))
    return access.drift(drive, git).select("side", "c_custkey", "role")


on("jurisdiction_filter", "region nation customer", lambda r, n, c: c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r.where("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n")), "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' GROUP BY 1")


# Documents -----------------------------------------------------------------

_EMAIL, _IP = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"
_HITS = f"len(regexp_extract_all(coalesce(text, ''), '{_EMAIL}')) AS n_email, len(regexp_extract_all(coalesce(text, ''), '{_IP}')) AS n_ip"
on("section_numbering", "documents", documents.section_numbers, """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
s AS (SELECT *, CAST(sum(CASE WHEN line LIKE '%.' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS section FROM l)
SELECT doc_id, pos, section || '.' || (row_number() OVER (PARTITION BY doc_id, section ORDER BY pos) - 1) AS number FROM s""")
on("template_forks", "benchmark documents", documents.template_forks, "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0")
on("template_gallery", "benchmark documents", lambda b, d: documents.gallery(documents.template_forks(b, d)), "SELECT item_id, count(*) AS n_forks FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0 GROUP BY 1 ORDER BY n_forks DESC, item_id LIMIT 10")
on("redaction_hits", "documents", documents.redaction_hits, f"SELECT doc_id, {_HITS} FROM documents")
on("redaction_masked", "documents", documents.redaction_masked, f"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '{_EMAIL}', '[EMAIL]', 'g'), '{_IP}', '[IP]', 'g'), '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}', '[SSN]', 'g')) AS md5_masked FROM documents")
on("redaction_pending", "documents labels", documents.redaction_pending, f"SELECT doc_id FROM (SELECT doc_id, {_HITS} FROM documents) h WHERE (n_email > 0 OR n_ip > 0) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = h.doc_id)")
on("review_rates", "documents labels", activity.review_rate, "SELECT round(count(l.doc_id) / count(*), 6) AS rate FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
on("html_to_text", "pages", documents.page_text, "SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>[^<]*</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS n_chars FROM pages")
_EDGES = """WITH e AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) """
on("reference_edges", "pages", documents.reference_edges, _EDGES + "SELECT page_id, href FROM e")
on("reference_degree_topk", "pages", lambda p: documents.reference_degrees(documents.reference_edges(p)), _EDGES + "SELECT href, count(DISTINCT page_id) AS n_pages FROM e GROUP BY 1 ORDER BY n_pages DESC, href LIMIT 20")
on("reference_dangling", "pages", lambda p: documents.dangling(documents.reference_edges(p), p), _EDGES + "SELECT DISTINCT page_id, href FROM e WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.url = e.href)")
on("impact_count", "pages", lambda p: documents.impact(documents.reference_edges(p)), _EDGES + "SELECT href, count(DISTINCT page_id) AS n_affected FROM e GROUP BY 1")
# DuckDB measures this distance in bytes, so tests hold it against a plain computation instead.
on("wording_similarity", "benchmark benchmark", lambda a, b: a.select(F.col("item_id").alias("a_id"), F.col("text").alias("x")).join(b.select((F.col("item_id") - 1).alias("a_id"), F.col("item_id").alias("b_id"), F.col("text").alias("y")), "a_id").select("a_id", "b_id", F.levenshtein("x", "y").alias("distance")))

# Activity ------------------------------------------------------------------

on("lock_in_force", "events", activity.lock_in_force, "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lock_event_id FROM events")
on("edit_overlap", "events", activity.overlapping, "WITH e AS (SELECT *, epoch(date_trunc('second', ts)) AS s FROM events WHERE event_type = 'click') SELECT a.event_id AS a_event, b.event_id AS b_event FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(a.s - b.s) <= 600")
on("edit_sessions", "events", lambda e: activity.sessions(e), """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
on("rate_limit_hourly", "events", activity.hourly_limit, "SELECT date_trunc('hour', ts) AS hour, user_id, count(*) AS n, count(*) > 2 AS over FROM events GROUP BY 1, 2")
on("audit_cube", "events", activity.audit_cube, "SELECT event_type, user_id % 10 AS user_bucket, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 10)")
on("activity_distincts", "events", activity.distincts, "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types FROM events")
on("success_rate", "events", activity.success_rate, "SELECT round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS rate FROM events")
on("value_percentile", "events", activity.median_value, "SELECT round(quantile_cont(value, 0.5), 6) AS p50 FROM events")
on("semantic_topk", "embeddings", activity.semantic_top, """
WITH s AS (SELECT q.vec_id AS q, c.vec_id AS v, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 4) AS sim FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT q, v, sim FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, v) AS r FROM s) WHERE r <= 5""")


def _values(rows: tuple) -> str:
    return ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)


@query(f"SELECT CAST(y AS INTEGER) AS year, t AS tier, CAST(sum(c * p * 12) AS BIGINT) AS total FROM (VALUES {_values(activity.REVENUE)}) x(y, t, c, p) GROUP BY ROLLUP (y, t)")
def revenue_rollup(spark: SparkSession, d: str) -> DataFrame:
    return activity.revenue_rollup(spark)


@query(f"SELECT g AS grp, CAST(sum(c) AS BIGINT) AS total FROM (VALUES {_values(activity.COSTS)}) x(g, i, c) GROUP BY ROLLUP (g)")
def cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    return activity.cost_rollup(spark)


