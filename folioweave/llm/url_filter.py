"""URL filter: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

The list may be huge, so pages don't meet it directly. Every page's lookup keys are tested
against a blocked Bloom filter, whose rows are small; only possible hits reach the exact hash
join with the list, which removes the filter's false positives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lower_ascii, maybe_broadcast

#: The dealt rules as verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: The query's own block list: sites listed with all that lies under them.
SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
TOPS = ("com", "net", "org")
#: Numbers of the generated sites: each of SITES under each of TOPS, bare and with every number below.
NUMBERED = 60_000
WORDS_PER_BLOCK = 4
PROBES = 8
KEYS_PER_BLOCK = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule's verdict and name, null if none fits. Between equal lengths a block wins."""
    verdict, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        verdict, name = F.when(fits, what).otherwise(verdict), F.when(fits, h + p).otherwise(name)
    return verdict, name


def canonical_host(host: Column) -> Column:
    """Without a port, user, trailing dots and a leading www."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.*(:\d*)?$", ""), r"^www\d*\.", "")


def lookup_keys(host: Column, path: Column, labels_listed: int, depth_listed: int, fewest_labels: int = 1) -> Column:
    """The canonical URLs under which a page may be listed: its whole path and leading
    directories, each under its host and the host's parent domains.

    Keys of more than ``labels_listed`` host labels or fewer than ``fewest_labels``, and directories
    of more than ``depth_listed`` slashes, are left out: no entry of the list has so many or so few.
    """
    host = canonical_host(host)
    labels = F.split(host, r"\.")
    most = F.size(labels)
    hosts = F.array_distinct(F.transform(F.sequence(F.greatest(most - labels_listed, F.lit(0)), F.greatest(most - min(fewest_labels, labels_listed), F.lit(0))), lambda k: F.array_join(F.slice(labels, k + 1, most), ".")))
    path = F.when(path == "", "/").otherwise(F.regexp_replace(path, "/+", "/"))
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    prefixes = F.transform(F.sequence(F.lit(1), F.least(depth, F.lit(max(depth_listed, 1)))), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))
    paths = F.array_distinct(F.array_append(prefixes, path))
    return F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p)))))


def canonical_list(listed: DataFrame) -> DataFrame:
    """Column url to distinct canonical keys; entries without a host are left out."""
    host, path = host_and_path(F.col("url"))
    return listed.select(F.concat(canonical_host(host), F.when(path == "", "/").otherwise(F.regexp_replace(path, "/+", "/"))).alias("key")).where(~F.col("key").startswith("/")).distinct()


def _bits(key: Column) -> list[Column]:
    """For each word of a block, the bits that a key sets: PROBES bits out of 256 from one hash."""
    second = F.xxhash64(F.lit("bits"), key)
    place = [F.shiftrightunsigned(second, 8 * k).bitwiseAND(F.lit(255)) for k in range(PROBES)]
    one = F.lit(1).cast("long")

    def word(w: int) -> Column:
        parts = [F.when(F.shiftright(p, 6) == w, F.call_function("shiftleft", one, p.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long")) for p in place]
        return reduce(lambda a, b: a.bitwiseOR(b), parts)

    return [word(w) for w in range(WORDS_PER_BLOCK)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom_blocks(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The filter as a row per block that has a key: block, and its words of 64 bits."""
    blocks = max(1, -(-n // KEYS_PER_BLOCK))
    bits = keys.select(_block(F.col("key"), blocks).alias("block"), *[b.alias(f"w{k}") for k, b in enumerate(_bits(F.col("key")))])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS_PER_BLOCK)]), blocks


def listed_pages(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct url of the pages whose lookup keys meet the list: Bloom filter first, exact hash join after."""
    keys = cut(canonical_list(listed))
    parts = F.split("key", "/")
    labels = F.size(F.split(parts[0], r"\."))
    n, most, fewest, depth = keys.agg(F.count("*"), *[F.coalesce(x, F.lit(1)) for x in (F.max(labels), F.min(labels), F.max(F.size(parts) - 1))]).first()
    filter_rows, blocks = bloom_blocks(keys, n)
    urls = pages.select("url").where(F.col("url").isNotNull()).distinct()
    probes = urls.select("url", F.explode(lookup_keys(*host_and_path(F.col("url")), most, depth, fewest)).alias("key")).withColumn("block", _block(F.col("key"), blocks))
    hit = reduce(lambda a, b: a & b, [F.col(f"w{k}").bitwiseAND(b) == b for k, b in enumerate(_bits(F.col("key")))])
    possible = probes.join(maybe_broadcast(filter_rows, -(-n // KEYS_PER_BLOCK), 1_000_000), "block").where(hit).select("url", "key")
    exact = keys if n > 10_000 else F.broadcast(keys)
    return possible.join(exact.hint("shuffle_hash") if n > 10_000 else exact, "key", "left_semi").select("url").distinct()


def judge_urls(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict for every row of ``pages``.

    The longest fitting rule decides; where none fits, a URL on the list is blocked and any
    other allowed. A null url, or one without ``://``, has an empty host and path, and is
    allowed. Repeated rows are judged each; an empty list blocks nothing.
    """
    host, path = host_and_path(F.col("url"))
    verdict, name = rule_for(F.col("host"), F.col("path"), rules)
    ruled = pages.select("page_id", "url").withColumns({"host": host, "path": path}).withColumns({"ruled": verdict, "rule": name})
    bad = listed_pages(ruled.where("ruled is null"), listed).withColumn("on_list", F.lit(True))
    out = ruled.join(bad, "url", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("on_list"), "block").otherwise("allow")).alias("verdict"))


def default_list(spark: SparkSession, numbered: int = NUMBERED) -> DataFrame:
    """The query's own list, about a million sites: ads-track.example.com, ads-track-0.example.com and so on."""
    each = F.explode(F.array(*[F.struct(F.lit(site).alias("site"), F.lit(top).alias("top")) for site in SITES for top in TOPS]))
    named = spark.range(-1, numbered).select(F.when(F.col("id") < 0, "").otherwise(F.concat(F.lit("-"), F.col("id").cast("string"))).alias("n"), each.alias("x"))
    return named.select(F.concat(F.lit("http://"), F.col("x.site"), F.col("n"), F.lit(".example."), F.col("x.top"), F.lit("/")).alias("url"))


#: The same in SQL. All entries are whole sites, so a page is listed if its host or a parent domain is.
ORACLE_SQL = f"""
WITH RECURSIVE p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), rules(verdict, h, p) AS (VALUES {", ".join(repr(r) for r in RULES)}
), ruled AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
    (SELECT max_by(struct_pack(v := verdict, n := r.h || r.p), length(r.h || r.p)) FROM rules r WHERE (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)) AS x
  FROM h
), listed AS (
  SELECT site || n || '.example.' || top AS host FROM (VALUES {", ".join(f"('{s}')" for s in SITES)}) a(site), (VALUES {", ".join(f"('{t}')" for t in TOPS)}) b(top),
    (SELECT '' AS n UNION ALL SELECT '-' || range FROM range({NUMBERED})) c
), own AS (
  SELECT DISTINCT host, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), '\\.*(:[0-9]*)?$', ''), '^www[0-9]*\\.', '') AS name FROM ruled WHERE x IS NULL
), parents AS (
  SELECT host, array_to_string(string_split(name, '.')[k:], '.') AS name FROM (SELECT host, name, unnest(range(1, len(string_split(name, '.')) + 1)) AS k FROM own)
), bad AS (SELECT DISTINCT host FROM parents SEMI JOIN listed ON listed.host = parents.name)
SELECT page_id, ruled.host, path, x.n AS rule, coalesce(x.v, CASE WHEN bad.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled LEFT JOIN bad ON bad.host = ruled.host
"""
