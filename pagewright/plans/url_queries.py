"""Queries on URLs, hosts and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import labels as L
from pagewright.functions import urls as U
from pagewright.plans.registry import register
from pagewright.plans.session import table

#: SQL for the shape of URLs of the test tables; a path of theirs holds no dot segment.
SQL_URLS = r"""
parts AS (SELECT page_id, url, html, regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['scheme', 'host', 'path', 'query']) AS p FROM pages),
canon AS (SELECT page_id, url, html, p.scheme AS scheme, lower(p.host) AS host, p.path AS path,
  p.scheme || '://' || lower(p.host) || CASE WHEN rtrim(p.path, '/') = '' THEN '/' ELSE rtrim(p.path, '/') END ||
  CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS key
  FROM (SELECT *, list_sort(list_filter(string_split(p.query, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|ref|mc_eid|_ga|fbclid|gclid)(=|$)'))) AS kept FROM parts))
"""
SQL_LINKS = (
    SQL_URLS
    + r""", refs AS (SELECT page_id, scheme, host, key, unnest(regexp_extract_all(html, '<a\b[^>]*href="([^"]+)"', 1)) AS ref FROM canon),
links AS (SELECT page_id, scheme, host, key AS page_key, ref, scheme || '://' || host ||
  array_to_string(list_transform(string_split(CASE WHEN length(ref) > 1 THEN rtrim(ref, '/') ELSE ref END, ''), lambda c: CASE WHEN regexp_matches(c, '^[\x21\x24-\x3B\x3D\x40-\x5F\x61-\x7A\x7C\x7E]?$') THEN c ELSE url_encode(c) END), '') AS link FROM refs)
"""
)


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each link of each page, resolved: (page_id, url, host, ref, link)."""
    pages = table(spark, sf_dir, "pages")
    refs = F.regexp_extract_all("html", F.lit(r'<a\b[^>]*href="([^"]+)"'), F.lit(1))
    flat = pages.select("page_id", "url", U.url_parts(F.col("url"))["host"].alias("host"), F.explode(refs).alias("ref"))
    return flat.withColumn("link", U.resolve_url(F.col("url"), F.col("ref")))


@register(
    "host_link_summary",
    "WITH "
    + SQL_LINKS
    + r""", heads AS (SELECT host, count(DISTINCT key) AS pages, avg(len(regexp_extract_all(html, '<h[1-6]'))) AS mean_headings FROM canon GROUP BY host),
sums AS (SELECT host, count(*) AS internal_links, count(DISTINCT link) AS distinct_links FROM links GROUP BY host)
SELECT heads.host, pages, round(mean_headings, 6) AS mean_headings, coalesce(internal_links, 0) AS internal_links, coalesce(distinct_links, 0) AS distinct_links FROM heads LEFT JOIN sums USING (host)""",
)
def host_link_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per host: distinct canonical pages, mean headings, links within the host.  Links are counted per page first."""
    pages = table(spark, sf_dir, "pages").select(U.normalize_url(F.col("url")).alias("key"), U.url_parts(F.col("url"))["host"].alias("host"), F.size(F.regexp_extract_all("html", F.lit("<h[1-6]"), F.lit(0))).alias("headings"))
    heads = pages.groupBy("host").agg(F.count_distinct("key").alias("pages"), F.round(F.avg("headings"), 6).alias("mean_headings"))
    links = page_links(spark, sf_dir).withColumn("kind", U.CrawlScope().classify(F.col("link"), F.col("url")))
    sums = links.where("kind = 'internal'").groupBy("host").agg(F.count("*").alias("internal_links"), F.count_distinct("link").alias("distinct_links"))
    out = heads.join(sums, "host", "left")
    return out.select("host", "pages", "mean_headings", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("internal_links", "distinct_links")])


@register("url_normalize", "WITH " + SQL_URLS + " SELECT page_id, key, host, CASE scheme WHEN 'https' THEN 443 ELSE 80 END AS port, path, regexp_matches(lower(path), '/login|/signin|/sign-in|/auth|/oauth/authorize|/accounts/login|/session/new') AS login FROM canon")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = U.url_parts(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", U.normalize_url(F.col("url")).alias("key"), parts["host"].alias("host"), U.effective_port(parts).alias("port"), U.path_for_url(F.col("url")).alias("path"), U.looks_like_login(F.col("url")).alias("login"))


@register("url_resolve_links", "WITH " + SQL_LINKS + " SELECT page_id, ref, link, 'internal' AS kind FROM links")
def url_resolve_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = page_links(spark, sf_dir)
    return links.select("page_id", "ref", "link", U.CrawlScope().classify(F.col("link"), F.col("url")).alias("kind"))


@register(
    "url_scope_kinds",
    "WITH "
    + SQL_URLS
    + """, seeds AS (SELECT min(host) AS seed FROM canon) SELECT page_id,
CASE WHEN host = seed AND scheme = 'https' THEN 'internal' ELSE 'external' END AS exact,
CASE WHEN (host = seed OR ends_with(host, '.' || seed)) AND scheme = 'https' THEN 'internal' ELSE 'external' END AS with_subdomains,
CASE WHEN host = seed AND scheme = 'https' AND (path = '/en' OR starts_with(path, '/en/')) THEN 'internal' ELSE 'external' END AS below_en FROM canon, seeds""",
)
def url_scope_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page against the crawl scope of the first host: one row of scope, broadcast."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    seed = pages.agg(F.concat(F.lit("https://"), F.min(U.url_parts(F.col("url"))["host"])).alias("seed"))
    kinds = {"exact": U.CrawlScope(), "with_subdomains": U.CrawlScope(include_subdomains=True), "below_en": U.CrawlScope(base_path="/en")}
    return pages.join(F.broadcast(seed)).select("page_id", *[s.classify(F.col("url"), F.col("seed")).alias(n) for n, s in kinds.items()])


_VARIANTS = {
    0: ("u", "u"),
    1: ("replace(u, '://', '://user:pw@')", "'credentials_in_url'"),
    2: ("concat('ftp', substr(u, instr(u, ':')))", "'scheme_rejected'"),
    3: ("'http://127.0.0.1/x'", "'prohibited_ip'"),
    4: ("'http://0x0a000001:8080/'", "'prohibited_ip'"),
    5: ("'http://example.com:81/'", "'port_rejected'"),
    6: ("'  '", "'malformed_url'"),
    7: ("concat(u, '?', repeat('a', 2048))", "'url_too_long'"),
}


@register("url_policy", "SELECT page_id, CASE page_id % 8 " + " ".join(f"WHEN {k} THEN {'NULL' if k == 0 else reason}" for k, (_, reason) in _VARIANTS.items()) + " END AS reason FROM pages")
def url_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape policy over variants of every URL; what each variant must give is known."""
    made = F.expr("CASE page_id % 8 " + " ".join(f"WHEN {k} THEN {v}" for k, (v, _) in _VARIANTS.items()) + " END")
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("u")).select("page_id", U.screen_url(made).alias("reason"))


@register(
    "url_policy_resolved",
    """WITH hosts AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages),
ans AS (SELECT host, CASE WHEN length(host) % 3 = 0 THEN NULL WHEN length(host) % 3 = 1 THEN 'prohibited_ip' ELSE 'ok' END AS a FROM hosts)
SELECT page_id, CASE WHEN a IS NULL THEN 'dns_resolution_failed' WHEN a = 'prohibited_ip' THEN a END AS reason FROM pages JOIN ans ON host = regexp_extract(url, '://([^/?#]*)', 1)""",
)
def url_policy_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole policy: the shape, then a left join with resolved addresses; one blocked address denies the host."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", U.url_parts(F.col("url"))["host"].alias("host"))
    resolved = pages.select("host").distinct().where("length(host) % 3 > 0").select("host", F.expr("explode(if(length(host) % 3 = 1, array('93.184.216.34', '10.1.2.3'), array('93.184.216.34')))").alias("address"))
    judged = resolved.groupBy("host").agg(F.bool_or(U.classify_ipv4(U.parse_ipv4(F.col("address"))).isNotNull()).alias("blocked"))
    shape = U.screen_url(F.col("url"))
    reason = F.coalesce(shape, F.when(F.col("blocked").isNull(), "dns_resolution_failed").when(F.col("blocked"), "prohibited_ip"))
    return pages.join(judged, "host", "left").select("page_id", reason.alias("reason"))


@register(
    "ipv4_classify",
    """WITH a AS (SELECT c_custkey, (c_custkey * 2654435761) % 4294967296 AS v FROM customer)
SELECT c_custkey, CAST(v AS BIGINT) AS address, CASE
 WHEN v IN (2852039166, 1684301000) THEN 'metadata_service' WHEN v >> 24 = 0 THEN 'unspecified' WHEN v >> 24 = 127 THEN 'loopback' WHEN v >> 24 = 10 THEN 'private'
 WHEN v >> 20 = 2753 THEN 'private' WHEN v >> 16 = 49320 THEN 'private' WHEN v >> 16 = 43518 THEN 'link_local' WHEN v >> 22 = 401 THEN 'private'
 WHEN v >> 8 IN (12582912, 12582914) THEN 'reserved' WHEN v >> 17 = 25353 THEN 'reserved' WHEN v >> 8 IN (12989284, 13303921) THEN 'reserved'
 WHEN v = 4294967295 THEN 'broadcast' WHEN v >> 28 = 14 THEN 'multicast' WHEN v >> 28 = 15 THEN 'reserved' END AS reason FROM a""",
)
def ipv4_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses written in turn as dotted, short, hexadecimal and whole numbers."""
    v = F.expr("(c_custkey * 2654435761) % 4294967296")
    part = lambda s: F.shiftright("v", s).bitwiseAND(F.lit(255)).cast("string")
    dotted = F.concat_ws(".", part(24), part(16), part(8), part(0))
    short = F.concat_ws(".", part(24), F.col("v").bitwiseAND(F.lit(0xFFFFFF)).cast("string"))
    text = F.when(F.expr("c_custkey % 4 = 0"), dotted).when(F.expr("c_custkey % 4 = 1"), short).when(F.expr("c_custkey % 4 = 2"), F.concat(F.lit("0x"), F.hex("v"))).otherwise(F.col("v").cast("string"))
    made = table(spark, sf_dir, "customer").select("c_custkey", v.alias("v")).select("c_custkey", U.parse_ipv4(text).alias("address"))
    return made.select("c_custkey", "address", U.classify_ipv4(F.col("address")).alias("reason"))


_GROUP = "((event_id * 2654435761) // 65536) % 65536"
_V6 = f"""WITH a AS (SELECT event_id, event_id % 9 AS k, {_GROUP} AS g, (event_id * 40503) % 4294967296 AS v FROM events),
b AS (SELECT event_id, k, g, v, k > 1 AND k < 8 AS six, CASE WHEN k = 8 THEN (g % 256) * 16777216 + v % 16777216 ELSE v END AS four FROM a),
c AS (SELECT *, CASE WHEN four IN (2852039166, 1684301000) THEN 'metadata_service' WHEN four >> 24 = 0 THEN 'unspecified' WHEN four >> 24 = 127 THEN 'loopback' WHEN four >> 24 = 10 THEN 'private'
 WHEN four >> 20 = 2753 THEN 'private' WHEN four >> 16 = 49320 THEN 'private' WHEN four >> 16 = 43518 THEN 'link_local' WHEN four >> 22 = 401 THEN 'private'
 WHEN four >> 8 IN (12582912, 12582914) THEN 'reserved' WHEN four >> 17 = 25353 THEN 'reserved' WHEN four >> 8 IN (12989284, 13303921) THEN 'reserved'
 WHEN four = 4294967295 THEN 'broadcast' WHEN four >> 28 = 14 THEN 'multicast' WHEN four >> 28 = 15 THEN 'reserved' END AS four_reason FROM b)
SELECT event_id, k > 0 AS is_ip, CASE WHEN k = 0 THEN NULL WHEN k IN (1, 8) THEN four_reason
 WHEN k = 2 THEN 'loopback' WHEN k = 3 THEN 'unspecified' WHEN k = 4 THEN 'metadata_service'
 WHEN g >= 64512 AND g < 65024 THEN 'unique_local' WHEN g >= 65152 AND g < 65216 THEN 'link_local' WHEN g >= 65280 THEN 'multicast' WHEN k = 5 AND g < 64512 THEN 'reserved' END AS reason FROM c"""


@register("ip_literals", _V6)
def ip_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts made of numbers: names, addresses of both kinds in brackets and bare, mapped ones, with zones, in all ranges."""
    g = F.expr(_GROUP.replace("//", "div"))
    v = F.expr("(event_id * 40503) % 4294967296")
    octet = lambda x, s: F.shiftright(x, s).bitwiseAND(F.lit(255)).cast("string")
    dotted = lambda x: F.concat_ws(".", *[octet(x, s) for s in (24, 16, 8, 0)])
    mapped = (g % 256) * 16777216 + v % 16777216
    k = F.col("event_id") % 9
    hexed = F.lower(F.hex(F.when((g == 0) | (g == 8193), F.lit(1)).otherwise(g)))
    any_ = F.concat(hexed, F.lit(":0:"), F.lower(F.hex(v % 65536)), F.lit("::1"))
    host = (
        F.when(k == 0, F.concat(F.lit("h"), F.col("event_id").cast("string"), F.lit(".example")))
        .when(k == 1, dotted(v))
        .when(k == 2, "[::1]")
        .when(k == 3, "::")
        .when(k == 4, "[fd00:ec2::254]")
        .when(k == 5, F.concat(F.when(g >= 64512, hexed).otherwise("2001"), F.when(g >= 64512, F.lit("::")).otherwise(F.lit(":db8::")), F.lower(F.hex(v % 65536))))
        .when(k == 6, F.concat(F.lit("["), any_, F.lit("]")))
        .when(k == 7, F.concat(any_, F.lit("%eth0")))
        .otherwise(F.concat(F.lit("[::ffff:"), dotted(mapped), F.lit("]")))
    )
    made = table(spark, sf_dir, "events").select("event_id", host.alias("host"))
    return made.select("event_id", U.classify_ip_literal(F.col("host")).alias("c")).select("event_id", "c.is_ip", "c.reason")


_V6_SUPPLIERS = """SELECT s_suppkey, address, CASE WHEN starts_with(address, 'zz') THEN NULL WHEN starts_with(address, 'fc00') THEN 'unique_local' WHEN starts_with(address, 'fe80') THEN 'link_local' WHEN starts_with(address, 'ff02') THEN 'multicast'
 WHEN starts_with(address, '2001:db8') THEN 'reserved' WHEN starts_with(address, '::ffff:10.') AND regexp_matches(address, '[0-9]$') THEN 'private' WHEN starts_with(address, '::ffff') THEN NULL ELSE '' END AS reason
FROM (SELECT s_suppkey, ['fc00::', 'fe80::', 'ff02::', '2001:db8::', '2606:4700::', '::ffff:10.0.0.', 'zz::'][s_suppkey % 7 + 1] || lower(to_hex(s_suppkey % 10 + 2)) AS address FROM supplier)"""


@register("ipv6_classify", _V6_SUPPLIERS)
def ipv6_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made of keys under several prefixes; the tests know the classes."""
    prefix = F.element_at(F.array(*map(F.lit, ("fc00::", "fe80::", "ff02::", "2001:db8::", "2606:4700::", "::ffff:10.0.0.", "zz::"))), (F.col("s_suppkey") % 7 + 1).cast("int"))
    text = F.concat(prefix, F.lower(F.hex(F.col("s_suppkey") % 10 + 2)))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("address")).withColumn("reason", U.classify_ipv6("address"))


@register(
    "cookie_scopes",
    r"""WITH h AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages), d AS (SELECT page_id, host, CASE page_id % 4 WHEN 0 THEN host WHEN 1 THEN regexp_replace(host, '^[^.]*\.', '') WHEN 2 THEN 'sub.' || host ELSE substr(host, 2) END AS domain FROM h)
SELECT page_id, domain, host = domain OR ends_with(host, '.' || domain) AS cookie, page_id % 4 = 0 AS origin, (page_id % 4 = 1) AS never FROM d""",
)
def cookie_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cookies of each page's host, its parent, a subdomain and another name; and origins of these hosts."""
    k, host = F.col("page_id") % 4, U.url_parts(F.col("url"))["host"]
    domain = F.when(k == 0, host).when(k == 1, F.regexp_replace(host, r"^[^.]*\.", "")).when(k == 2, F.concat(F.lit("sub."), host)).otherwise(F.substring(host, 2, 1_000))
    rows = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), domain.alias("domain"), F.when(k == 1, "link_local").when(k == 2, "private").alias("why"))
    cookie = U.cookie_in_scope(F.concat(F.lit("."), F.upper("domain")), F.upper("host"))
    return rows.select("page_id", "domain", cookie.alias("cookie"), U.origin_in_scope(F.concat(F.lit("https://"), "domain", F.lit(":8443/x")), F.col("host")).alias("origin"), U.is_never_trustable(F.col("why")).alias("never"))


@register(
    "service_addresses",
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'required' WHEN 2 THEN 'whitespace' WHEN 3 THEN 'not_absolute' WHEN 4 THEN 'scheme' WHEN 5 THEN 'credentials' END AS error,
CASE WHEN doc_id % 6 = 0 THEN 'https://' || coalesce(source, '') || '.example/v' || doc_id END AS base FROM documents""",
)
def service_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of services made of each document's source, good and bad."""
    k, name = F.col("doc_id") % 6, F.concat(F.coalesce("source", F.lit("")), F.lit(".example/v"), F.col("doc_id").cast("string"))
    url = F.when(k == 0, F.concat(F.lit(" https://"), name, F.lit("// "))).when(k == 1, "  ").when(k == 2, F.concat(F.lit("https://a b"), name)).when(k == 3, name).when(k == 4, F.concat(F.lit("ftp://"), name)).otherwise(F.concat(F.lit("https://u:p@"), name))
    rows = table(spark, sf_dir, "documents").select("doc_id", url.alias("url"))
    error = L.base_url_error(F.col("url"))
    return rows.select("doc_id", error.alias("error"), F.when(error.isNull(), L.normal_base_url(F.col("url"))).alias("base"))


@register(
    "target_validation",
    """WITH x AS (SELECT doc_id % 7 AS k, doc_id FROM documents) SELECT doc_id,
CASE k WHEN 0 THEN 'https://example.com/a' WHEN 1 THEN 'https://www.example.com' WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN 'https://example.com:8443/x/y?b=1' END AS url,
CASE k WHEN 2 THEN 'empty' WHEN 3 THEN 'scheme_rejected' WHEN 4 THEN 'missing_host' WHEN 5 THEN 'invalid' END AS reason,
CASE k WHEN 2 THEN '' WHEN 3 THEN 'ftp://example.com' WHEN 4 THEN 'https://localhost' WHEN 5 THEN 'https://a b.com' WHEN 0 THEN 'HTTPS://Example.com/a/' WHEN 1 THEN 'https://www.example.com' WHEN 6 THEN 'https://example.com:8443/x/./z/../y?b=1' END AS input,
'https://h/p' AS joined FROM x""",
)
def target_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, (" HTTPS://Example.com/a/ ", "www.example.com", "  ", "ftp://example.com", "localhost", "a b.com", "example.com:8443/x/./z/../y?b=1"))), (F.col("doc_id") % 7 + 1).cast("int"))
    made = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")).withColumn("v", U.validate_target_url(F.col("raw")))
    return made.select("doc_id", "v.url", "v.reason", U.normalize_url_input(F.col("raw")).alias("input"), U.join_url(F.lit("https://h//"), F.lit("/p")).alias("joined"))
