"""Queries over use and business, packages and interchange."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import commits, documents, references, reports, versions
from ..operators.access import roles
from ..session import stored
from ..sources import formats
from . import drafts
from .registry import on

on("monthly_active_share", "events", reports.monthly_active, "SELECT strftime(ts, '%Y-%m') AS month, count(DISTINCT user_id) AS active, round(count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events), 6) AS share FROM events GROUP BY 1")
on("feature_adoption", "events", reports.adoption, """
SELECT round(count(DISTINCT user_id) FILTER (event_type = 'purchase') / count(DISTINCT user_id), 6) AS advanced, round(count(DISTINCT user_id) FILTER (event_type = 'view') / count(DISTINCT user_id), 6) AS tutorial,
  round(count(DISTINCT user_id) FILTER (event_type = 'error' AND value > 100) / count(DISTINCT user_id), 6) AS tickets, count(DISTINCT user_id) FILTER (event_type = 'signup' AND value > 200) AS contributors FROM events""")
on("promoter_score", "events", reports.promoter_score, "SELECT round(avg(CASE WHEN least(floor(value / 10), 10) >= 9 THEN 1 WHEN floor(value / 10) <= 6 THEN -1 ELSE 0 END) * 100, 4) AS nps FROM events WHERE value IS NOT NULL")
on("response_times", "events", reports.response_times, "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS longest FROM events GROUP BY 1")
on("approximate_users", "events", reports.approximate_users)  # approximate by design: no SQL twin
on("template_share", "benchmark documents", lambda b, d: reports.template_share(d, documents.template_forks(b, d)), "SELECT round((SELECT count(DISTINCT source) FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE length(b.text) > 0 AND contains(d.text, b.text))) / count(DISTINCT source), 6) AS share FROM documents")
on("churn_by_year", "orders", reports.churn, """
WITH e AS (SELECT DISTINCT o_custkey AS c, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders)
SELECT a.y AS year, count(*) AS customers, count(*) - count(b.c) AS lost, round((count(*) - count(b.c)) / count(*), 6) AS rate FROM e a LEFT JOIN e b ON b.c = a.c AND b.y = a.y + 1 WHERE a.y < (SELECT max(y) FROM e) GROUP BY 1""")
on("lifetime_value", "orders customer", reports.lifetime_value, """
WITH s AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS spent FROM orders GROUP BY 1)
SELECT round(CAST(sum(spent) AS DOUBLE) / count(spent), 2) AS value, round(count(spent) / count(*), 6) AS penetration FROM customer LEFT JOIN s ON c_custkey = o_custkey""")
on("support_share", "lineitem", reports.support_share, "SELECT round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2)) * CAST(l_tax AS DECIMAL(4, 2))) AS DOUBLE) / CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE), 6) AS share FROM lineitem")
on("signature_packages", "orders lineitem", lambda o, f: reports.signature_packages(o, commits.file_totals(o, f)), """
WITH t AS (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS a, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, '{"document":"document.pdf","git_commit":"' || substring(sha256(CAST(o_orderkey AS VARCHAR)), 1, 20) || '","git_tag":"client-' || o_custkey || '-final-v' || coalesce(n, 0) || '.0","signature_timestamp":"'
  || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '","change_summary":"Added ' || coalesce(a, 0) || ' lines in ' || coalesce(n, 0) || ' files"}' AS package
FROM orders LEFT JOIN t ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""")
on("branch_names", "customer", reports.branches, "SELECT c_custkey, branch, regexp_matches(branch, '^[a-z0-9]+(-[a-z0-9]+)*$') AS valid FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Client Review ' || c_mktsegment ELSE lower(c_mktsegment) || '-review-' || c_custkey END AS branch FROM customer)")
on("contextual_warnings", "documents benchmark labels", lambda d, b, x: reports.warned(d, documents.template_forks(b, d), x), """
SELECT doc_id, concat_ws('|', CASE WHEN EXISTS (SELECT 1 FROM benchmark b WHERE length(b.text) > 0 AND contains(d.text, b.text)) THEN 'Remove all client-specific information' END,
  CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}') OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'This change will be permanently recorded' END,
  CASE WHEN source = 'src0' THEN 'This repo is visible to all firm members' END, CASE WHEN contains(text, '://') THEN 'Linking to confidential client matter' END) AS warnings FROM documents d""")
on("suggested_type", "conversations", lambda c: reports.suggested_type(versions.numstat(c)), """
WITH l AS (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM conversations), c AS (SELECT conv_id, turn, line, count(*) AS n FROM l GROUP BY ALL), v AS (SELECT DISTINCT conv_id, turn FROM conversations),
m AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn + 1) AS turn, coalesce(a.n, 0) AS cur, coalesce(b.n, 0) AS prev
  FROM c a FULL JOIN (SELECT c.* FROM c JOIN v ON v.conv_id = c.conv_id AND v.turn = c.turn + 1) b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 AND a.line = b.line),
s AS (SELECT conv_id, turn, sum(greatest(cur - prev, 0)) AS a, sum(greatest(prev - cur, 0)) AS d FROM m GROUP BY ALL),
t AS (SELECT conv_id, turn, unnest([{'s': greatest(a - d, 0), 't': 'feat'}, {'s': greatest(d - a, 0), 't': 'redact'}, {'s': least(a, d), 't': 'fix'}, {'s': CASE WHEN a + d = 0 THEN 1 ELSE 0 END, 't': 'format'}]) AS x FROM s)
SELECT conv_id, turn, t AS type FROM (SELECT conv_id, turn, x.t AS t, row_number() OVER (PARTITION BY conv_id, turn ORDER BY x.s DESC, x.t DESC) AS r FROM t) WHERE r = 1""")
on("property_values", "events", reports.property_values, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS rebuilt FROM events")
_NONE = "SELECT * FROM (VALUES ('lost', CAST(0 AS BIGINT)), ('made_up', CAST(0 AS BIGINT))) t(side, n)"
on("json_round_trip", "orders", lambda o: reports.sent_and_read_again(o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), reports.json_files), _NONE)
on("xml_round_trip", "customer", lambda c: reports.sent_and_read_again(roles(c), reports.xml_files), _NONE)
on("reference_share", "pages", lambda p: reports.reference_share(p, references.resolved(p)), """
WITH a AS (SELECT DISTINCT regexp_extract(html, '<div class="ad">([^ <]+)', 1) AS anchor FROM pages), e AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT round((SELECT count(DISTINCT page_id) FROM e JOIN a ON anchor <> '' AND anchor = regexp_replace(href, '^/', '')) / count(*), 6) AS share FROM pages""")


def _converted(d):
    """doc_id, before, markdown, word, plain: the normal form of marked-up documents, and what Markdown and Word files, written and read again, and text alone keep of it."""
    files = stored(formats.converted(drafts.marked_up(d), as_markdown=("to_markdown", "paragraphs"), as_word=("to_word", "paragraphs")))
    return formats.converted(files, before=("normal", "paragraphs"), markdown=("from_markdown", "as_markdown"), word=("from_word", "as_word"), plain=("plain", "paragraphs")).select("doc_id", "before", "markdown", "word", "plain")


def _round_trips(d):
    return _converted(d).select("doc_id", F.size("before").cast("long").alias("n_paragraphs"), *[F.col(c).eqNullSafe(F.col("before")).alias(f"same_{c}") for c in ("markdown", "word", "plain")])


def _accuracy(d):
    found, counts = stored(_converted(d)), []
    for c in ("markdown", "word", "plain"):
        lost = formats.losses(found, "doc_id", "before", c).select("doc_id", "pos").distinct().select(F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("lost"))
        counts += [x.select(F.lit(c).alias("conversion"), "n", "lost") for x in (lost, found.select(F.size("before").cast("long").alias("n"), F.lit(0).cast("long").alias("lost")))]
    every = counts[0]
    for more in counts[1:]:
        every = every.unionByName(more)
    return every.groupBy("conversion").agg(F.round(1 - F.sum("lost") / F.sum("n"), 9).alias("share"))


# A marked-up paragraph has lost something by way of text alone if any of its parts has.
on("round_trip_by_document", "documents", _round_trips, drafts.LOSSES_SQL + "SELECT doc_id, len(lines) AS n_paragraphs, true AS same_markdown, true AS same_word, doc_id NOT IN (SELECT doc_id FROM p) AS same_plain FROM x")
on("round_trip_accuracy", "documents", _accuracy, drafts.LOSSES_SQL + ", n AS (SELECT sum(len(lines)) AS n FROM x) SELECT 'markdown' AS conversion, 1.0::DOUBLE AS share UNION ALL SELECT 'word', 1.0 UNION ALL SELECT 'plain', round(1 - (SELECT count(DISTINCT (doc_id, pos)) FROM p) / n, 9) FROM n")
on("conversion_losses", "documents", lambda d: formats.losses(_converted(d), "doc_id", "before", "plain"), drafts.LOSSES_SQL + "SELECT doc_id, pos, part FROM p")
