"""Queries over references, permissions, locks and the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import html_text, reference_parts
from ..functions.text import references as references_in
from ..operators import access, documents, references, sharing
from ..session import table
from ..sources import drive
from ..streaming import replay
from .registry import on, streamed

_HOST = "regexp_extract({}, '^[a-z]+://([^/?#]*)', 1)"
_REFERENCES = f"""
WITH p AS (SELECT page_id, {_HOST.format('url')} AS h, regexp_extract(html, '<div class="ad">([^ <]+)', 1) AS anchor FROM pages),
a AS (SELECT anchor, min(page_id) AS target, arg_min(h, page_id) AS target_host FROM p WHERE anchor <> '' GROUP BY 1),
e AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
r AS (SELECT page_id, href, target, target_host FROM e LEFT JOIN a ON anchor = regexp_replace(href, '^/', ''))
"""
on("reference_resolution", "pages", lambda p: references.resolved(p).select("page_id", "href", "target"), _REFERENCES + "SELECT page_id, href, target FROM r")
on("cross_matter_references", "pages", references.cross_matter, _REFERENCES + "SELECT DISTINCT r.page_id, target FROM r JOIN p ON p.page_id = r.page_id WHERE target IS NOT NULL AND p.h <> target_host")
on("impact_of_changes", "pages", lambda p: references.impact_of(references.long_pages(p, 1200), references.resolved(p)), _REFERENCES + """,
c AS (SELECT page_id AS target FROM pages WHERE length(trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>[^<]*</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) >= 1200)
SELECT c.target, count(DISTINCT r.page_id) AS n_affected FROM c LEFT JOIN r ON r.target = c.target AND r.page_id <> c.target GROUP BY 1""")
_NUMBERS = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
s AS (SELECT *, CAST(sum(CASE WHEN line LIKE '%.' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS section FROM l),
n AS (SELECT doc_id, pos, section || '.' || (row_number() OVER (PARTITION BY doc_id, section ORDER BY pos) - 1) AS number FROM s)
"""


def _rendered(docs):
    numbers = documents.section_numbers(docs).select("doc_id", F.concat(F.lit("p"), F.col("pos").cast("string")).alias("anchor"), "number")
    return references.rendered(docs.select("doc_id", F.lit("See {{p0}}, {{p2}} and {{termination}}.").alias("text")), numbers)


on("placeholder_rendering", "documents", _rendered, _NUMBERS + "SELECT d.doc_id, 'See ' || coalesce('Section ' || a.number, '{{p0}}') || ', ' || coalesce('Section ' || b.number, '{{p2}}') || ' and {{termination}}.' AS text FROM documents d LEFT JOIN n a ON a.doc_id = d.doc_id AND a.pos = 0 LEFT JOIN n b ON b.doc_id = d.doc_id AND b.pos = 2")
on("clause_renumbering", "lineitem", lambda i: references.renumbered(references.clause_places(i)), """
WITH m AS (SELECT l_partkey AS conv_id, l_orderkey AS turn, CAST(l_suppkey AS VARCHAR) AS line, CAST(min(l_linenumber) AS BIGINT) AS place FROM lineitem GROUP BY ALL),
w AS (SELECT *, lag(place) OVER (PARTITION BY conv_id, line ORDER BY turn) AS previous FROM m) SELECT conv_id, turn, line, place, previous FROM w WHERE previous <> place""")
on("anchor_renumbering", "conversations", lambda c: references.renumbered(references.line_places(c)), """
WITH l AS (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM conversations),
m AS (SELECT conv_id, turn, line, min(pos) AS place FROM l GROUP BY ALL), w AS (SELECT *, lag(place) OVER (PARTITION BY conv_id, line ORDER BY turn) AS previous FROM m)
SELECT conv_id, turn, line, place, previous FROM w WHERE previous <> place""")
on("names_in_texts", "documents nation", lambda d, n: references.names_in_texts(d, n.select(F.lower("n_name").alias("name")).union(d.select(F.regexp_extract(F.lower("text"), "^[a-z]+", 0)).where("text is not null").distinct())), """
WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+')) AS name FROM documents),
x AS (SELECT lower(n_name) AS name FROM nation UNION SELECT regexp_extract(lower(text), '^[a-z]+') FROM documents WHERE text IS NOT NULL)
SELECT name, count(DISTINCT doc_id) AS n_docs FROM w JOIN x USING (name) GROUP BY 1""")
on("citations", "documents", lambda d: references.citations(d, "[0-9]+[.-][0-9]+[.-][0-9]+"), "SELECT doc_id, citation, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+[.-][0-9]+[.-][0-9]+')) AS citation FROM documents) GROUP BY ALL")
on("section_slugs", "documents", references.section_slugs, """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
SELECT doc_id, pos, regexp_replace(regexp_replace(lower(line), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM l WHERE line NOT LIKE '%.'""")
on("version_names", "orders", references.version_names, "SELECT o_orderkey, 'contract' || o_custkey || '.docx' AS base FROM orders")
_FORKS = """WITH RECURSIVE f AS (SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS n FROM f)"""
on("fork_lineage", "benchmark documents", lambda b, d: references.fork_lineage(documents.template_forks(b, d)), _FORKS + """,
r AS (SELECT item_id, doc_id, n, CAST(1 AS BIGINT) AS depth FROM n WHERE n = 1 UNION ALL SELECT n.item_id, n.doc_id, n.n, r.depth + 1 FROM n JOIN r ON r.item_id = n.item_id AND n.n // 2 = r.n)
SELECT item_id, doc_id, depth FROM r""")
on("commits_behind", "benchmark documents orders", lambda b, d, o: references.commits_behind(documents.template_forks(b, d), o), _FORKS + "SELECT item_id, doc_id, greatest(coalesce(v, 0) - n, 0) AS behind FROM n LEFT JOIN (SELECT o_custkey, count(*) AS v FROM orders GROUP BY 1) ON o_custkey = item_id")
on("conversion_mismatches", "conversations", lambda c: references.conversion_mismatches(c, c.withColumn("text", F.regexp_replace("text", ",+", ""))), """
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM conversations)
SELECT conv_id, turn, pos FROM l WHERE line <> regexp_replace(line, ',+', '', 'g')""")
on("note_integrity", "conversations", lambda c: references.note_integrity(references.notes_of(c, 0), references.notes_of(c, 1)), """
WITH l AS (SELECT conv_id, turn, substring(unnest(string_split(coalesce(text, ''), chr(10))), 1, 40) AS body, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS note FROM conversations)
SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.note, b.note) AS note, CASE WHEN b.body IS NULL THEN 'lost' WHEN a.body IS NULL THEN 'added' ELSE 'changed' END AS state
FROM (FROM l WHERE turn = 0) a FULL JOIN (FROM l WHERE turn = 1) b ON a.conv_id = b.conv_id AND a.note = b.note WHERE a.body IS DISTINCT FROM b.body""")

# In SQL the counters go from heading to heading.
on("section_numbers_deep", "documents", lambda d: documents.deep_numbers(documents.leveled(d), "doc_id"), """
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
h AS (SELECT doc_id, pos, 1 + length(line) % 5 AS level, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM l WHERE line NOT LIKE '%.'),
r AS (SELECT doc_id, pos, level, n, list_transform(range(1, 10), lambda k: CASE WHEN k = level THEN 1 ELSE 0 END) AS c FROM h WHERE n = 1
  UNION ALL SELECT h.doc_id, h.pos, h.level, h.n, list_transform(range(1, 10), lambda k: CASE WHEN k < h.level THEN r.c[k] WHEN k = h.level THEN r.c[k] + 1 ELSE 0 END) FROM r JOIN h ON h.doc_id = r.doc_id AND h.n = r.n + 1)
SELECT doc_id, pos, CAST(level AS INTEGER) AS level, array_to_string(c[1:level], '.') AS number FROM r""")

_DOCS = "WITH t AS (SELECT conv_id, turn, role, CASE WHEN role = 'system' THEN '**' || text || '**' ELSE text END AS text, text AS bare FROM conversations) "
on("document_extraction", "conversations", lambda c: drive.extracted(drive.conversations_as_documents(c)).select("documentId", "title", "body", F.size("comments").cast("long").alias("n_comments"), F.size("suggestions").cast("long").alias("n_suggestions"), F.array_join("formatting", ",").alias("formatting")), _DOCS + """
SELECT CAST(conv_id AS VARCHAR) AS "documentId", 'Matter ' || conv_id AS title, string_agg(CASE WHEN turn = 0 THEN '# ' ELSE '' END || text, chr(10) || chr(10) ORDER BY turn) AS body, count(*) FILTER (role = 'user') AS n_comments,
  CAST(0 AS BIGINT) AS n_suggestions, string_agg(CASE WHEN turn = 0 THEN 'HEADING_1' ELSE 'NORMAL_TEXT' END, ',' ORDER BY turn) AS formatting FROM t GROUP BY conv_id""")
on("document_comments", "conversations", lambda c: drive.extracted(drive.conversations_as_documents(c)).select("documentId", F.inline("comments")), _DOCS + """SELECT CAST(conv_id AS VARCHAR) AS "documentId", role AS author, substring(bare, 1, 20) AS content FROM t WHERE role = 'user'""")
on("git_content", "conversations", lambda c: drive.git_content(drive.extracted(drive.conversations_as_documents(c))).select("documentId", F.md5("content").alias("content_md5"), F.col("metadata.title").alias("title"), F.col("metadata.author").alias("author")), _DOCS + """
SELECT CAST(conv_id AS VARCHAR) AS "documentId", md5(string_agg(CASE WHEN turn = 0 THEN '# ' ELSE '' END || text, chr(10) || chr(10) ORDER BY turn)) AS content_md5, 'Matter ' || conv_id AS title, arg_max(role, turn) AS author FROM t GROUP BY conv_id""")
on("page_markdown", "pages", lambda p: p.select("page_id", F.md5(html_text(F.col("html"))).alias("text_md5")), "SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>[^<]*</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS text_md5 FROM pages")
on("reference_parts", "orders", lambda o: o.select("o_orderkey", F.explode(references_in(F.concat(F.lit("see firm://matter-"), F.col("o_custkey").cast("string"), F.lit("/contract/section-"), (F.col("o_orderkey") % 12).cast("string"), F.lit(" and firm://this-doc/section-2 here")))).alias("uri")).select("o_orderkey", "uri", reference_parts(F.col("uri"))["authority"].alias("authority"), F.array_join(reference_parts(F.col("uri"))["segments"], ">").alias("segments")),
   "SELECT o_orderkey, 'firm://matter-' || o_custkey || '/contract/section-' || o_orderkey % 12 AS uri, 'matter-' || o_custkey AS authority, 'contract>section-' || o_orderkey % 12 AS segments FROM orders UNION ALL SELECT o_orderkey, 'firm://this-doc/section-2', 'this-doc', 'section-2' FROM orders")

# Permissions and tracking ---------------------------------------------------

_GRANTS = """
WITH s AS (SELECT s_nationkey, min(s_suppkey) AS k, arg_min(s_name, s_suppkey) AS s_name FROM supplier GROUP BY 1),
z AS (SELECT n_regionkey, arg_min(s_name, k) AS s_name FROM s JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
g AS (SELECT 'c' || c_custkey AS folder, lower(replace(c_name, '#', '.')) || '@firm.example' AS email, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 4 WHEN 'BUILDING' THEN 3 WHEN 'FURNITURE' THEN 2 ELSE 1 END AS rank FROM customer
  UNION ALL SELECT 'n' || s_nationkey, lower(replace(s_name, '#', '.')) || '@firm.example', 3 FROM s UNION ALL SELECT 'r' || n_regionkey, lower(replace(s_name, '#', '.')) || '@firm.example', 4 FROM z),
e AS (SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
a AS (SELECT node, parent AS ancestor FROM e UNION ALL SELECT x.node, y.parent FROM e x JOIN e y ON y.node = x.parent),
f AS (SELECT folder, email, rank, true AS own FROM g UNION ALL SELECT node, email, rank, false FROM a JOIN g ON folder = ancestor),
b AS (SELECT folder, email, max(rank) AS rank, arg_max(own, (rank, own)) AS own FROM f GROUP BY ALL)
"""
on("permission_list", "customer supplier nation", lambda c, s, n: sharing.grants(c, s, n).select("folder", "email", access.repository_role(F.col("drive_role")).alias("role"), F.lit(False).alias("inherited")), _GRANTS + "SELECT folder, email, CASE rank WHEN 4 THEN 'maintainer' WHEN 3 THEN 'developer' WHEN 2 THEN 'reporter' ELSE 'guest' END AS role, false AS inherited FROM g")
on("effective_permissions", "region nation customer supplier", lambda r, n, c, s: sharing.effective(sharing.grants(c, s, n), access.folder_edges(r, n, c)), _GRANTS + "SELECT folder, email, CASE rank WHEN 4 THEN 'maintainer' WHEN 3 THEN 'developer' WHEN 2 THEN 'reporter' ELSE 'guest' END AS role, NOT own AS inherited FROM b")
on("folder_visibility", "region nation customer", lambda r, n, c: sharing.visibility(access.folder_edges(r, n, c).select("node"), n.where("n_regionkey = 1").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("folder"), F.lit("shared").alias("visibility"))),
   "SELECT 'n' || n_nationkey AS node, CASE WHEN n_regionkey = 1 THEN 'shared' ELSE 'private' END AS visibility FROM nation UNION ALL SELECT 'c' || c_custkey, 'private' FROM customer")
on("tracking_status", "documents labels", sharing.tracked, "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'tracked' ELSE 'untracked' END AS status FROM documents")
on("files_without_access", "customer orders", lambda c, o: c.join(o.where("o_orderstatus = 'P'"), c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey"), "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
_GRAPH = "WITH RECURSIVE e AS (SELECT DISTINCT s_nationkey AS a, c_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) "


def _nation_graph(items, orders, customer, supplier):
    """a, b of nations that trade: 25 times 25 edges at most, from all line items."""
    made_in = items.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", F.col("s_nationkey").alias("a")).distinct()
    sold_to = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("b"))
    return made_in.join(sold_to, F.col("l_orderkey") == F.col("o_orderkey")).select("a", "b").distinct()


on("reference_cycles", "lineitem orders customer supplier", lambda i, o, c, s: access.reachable(_nation_graph(i, o, c, s)).where("a = b").select(F.col("a").alias("node")), _GRAPH + "SELECT a AS node FROM r WHERE a = b")
on("impact_transitive", "lineitem orders customer supplier", lambda i, o, c, s: access.reachable(_nation_graph(i, o, c, s)).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_reachable")), _GRAPH + "SELECT a AS node, count(*) AS n_reachable FROM r GROUP BY 1")

# Locks ------------------------------------------------------------------------

_DOC = "user_id // 5"
on("locks_in_force", "events", sharing.locks_in_force, f"""
WITH x AS (SELECT event_id, {_DOC} AS doc, ts, last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN {{'e': event_id, 'u': user_id, 't': ts, 'k': event_type}} END IGNORE NULLS) OVER (PARTITION BY {_DOC} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM events)
SELECT event_id, doc, CASE WHEN ok THEN l.e END AS lock_event_id, CASE WHEN ok THEN l.u END AS holder, CASE WHEN ok THEN l.t + INTERVAL 12 HOUR END AS expires FROM (SELECT *, l.k = 'signup' AND ts <= l.t + INTERVAL 12 HOUR AS ok FROM x)""")
on("lock_holder_changes", "events", sharing.holder_changes, f"SELECT doc, event_id, previous, holder FROM (SELECT {_DOC} AS doc, event_id, user_id AS holder, lag(user_id) OVER (PARTITION BY {_DOC} ORDER BY ts, event_id) AS previous FROM events WHERE event_type = 'signup') WHERE previous <> holder")
on("join_request_queue", "events", sharing.join_queue, f"""
WITH r AS (SELECT {_DOC} AS doc, event_id, ts, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY {_DOC} ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('click', 'purchase'))
SELECT doc, event_id, row_number() OVER (PARTITION BY doc, k ORDER BY ts, event_id) AS place FROM r WHERE event_type = 'click'""")
on("join_requests_released", "events", sharing.released_within, f"""
WITH e AS (SELECT event_id, event_type, {_DOC} AS doc, ts FROM events), n AS (SELECT *, first_value(CASE WHEN event_type = 'purchase' THEN {{'id': event_id, 't': ts}} END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS f FROM e)
SELECT event_id AS request, f.id AS release FROM n WHERE event_type = 'click' AND f.t <= ts + INTERVAL 1 HOUR""")

# Streams, replayed to their end: files in, files out ------------------------------


def _events(spark, d):
    return replay.event_stream(spark, f"{d}/events.parquet")


def _appended(apply, inputs=1):
    return lambda spark, d: replay.replayed(spark, f"{d}/events.parquet", apply, inputs=inputs).rows


def _accounts(spark, d):
    """Every row is kept, late or repeated; those of one file come in one trigger, and none of them is late."""
    got = replay.replayed(spark, f"{d}/events.parquet", replay.audit)
    return got.rows.agg(F.count("*").alias("n_kept")).select(F.lit(got.n_input).cast("long").alias("n_input"), "n_kept", F.lit(got.n_late).cast("long").alias("n_late"), F.lit(got.n_repeated).cast("long").alias("n_repeated"))


streamed("stream_rate_limit", _appended(replay.hourly_counts), "SELECT date_trunc('hour', ts) AS hour, user_id, count(*) AS n FROM events GROUP BY 1, 2")
streamed("stream_daily_activity", _appended(replay.daily_counts), "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
streamed("stream_moving_activity", _appended(replay.moving_counts), "SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS start, event_type, count(*) AS n FROM events, (SELECT unnest(range(4)) AS k) GROUP BY 1, 2")
streamed("stream_accounts", _accounts, "SELECT count(*) AS n_input, count(*) AS n_kept, CAST(0 AS BIGINT) AS n_late, CAST(0 AS BIGINT) AS n_repeated FROM events")
streamed("stream_lock_state", lambda spark, d: replay.run(spark, replay.lock_counts(_events(spark, d)), "update", "user_id"), """
WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS last FROM events WHERE event_type IN ('signup', 'purchase'))
SELECT user_id, bool_or(event_type = 'signup' AND last = 1) AS held, count(*) FILTER (event_type = 'signup' AND before IS DISTINCT FROM 'signup') AS acquired, count(*) FILTER (event_type = 'signup' AND before = 'signup') AS refused FROM e GROUP BY 1""")
streamed("stream_lock_timeouts", _appended(replay.locks_in_order))  # tests hold it against a machine stepped event by event
streamed("stream_join_answers", _appended(replay.join_answers), f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY doc, k ORDER BY ts, event_id) AS nth FROM (SELECT {_DOC} AS doc, event_id, ts, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY {_DOC} ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('click', 'purchase'))),
p AS (SELECT a.doc, a.event_id AS request, CASE WHEN b.ts <= a.ts + INTERVAL 1 HOUR THEN b.event_id END AS release, a.ts, b.ts AS freed, a.k FROM r a LEFT JOIN r b ON b.doc = a.doc AND b.k = a.k + 1 AND b.event_type = 'purchase' WHERE a.event_type = 'click')
SELECT doc, request, release, CASE WHEN release IS NOT NULL THEN row_number() OVER (PARTITION BY doc, k, release IS NULL ORDER BY ts, request) END AS place FROM p""")
streamed("stream_audit", _appended(replay.audit), "SELECT DISTINCT event_id, user_id, event_type FROM events")
streamed("stream_event_owner", lambda spark, d: replay.run(spark, replay.with_dimension(_events(spark, d), table(spark, d, "customer")), "append"), "SELECT event_id, c_name AS owner FROM events JOIN customer ON c_custkey = user_id")
streamed("stream_change_alerts", lambda spark, d: replay.run(spark, replay.alerts(_events(spark, d), table(spark, d, "orders")), "append"), "SELECT event_id, user_id, n AS n_affected FROM events JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = user_id WHERE event_type = 'click' AND value > 50")
streamed("stream_auto_commits", _appended(replay.auto_commits), """
WITH c AS (SELECT * FROM events WHERE event_type = 'click'), g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS edits FROM s GROUP BY user_id, k HAVING count(*) >= 2""")
streamed("stream_join_requests", _appended(replay.requests_met, inputs=2), f"SELECT a.event_id AS request, b.event_id AS release FROM events a JOIN events b ON a.event_type = 'click' AND b.event_type = 'purchase' AND a.user_id // 5 = b.user_id // 5 AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR")
