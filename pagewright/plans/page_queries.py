"""Queries on pages: extraction and technology detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import html as H
from pagewright.functions import urls as U
from pagewright.operators import detect as D
from pagewright.operators.rules import SCHEMA, builtin, rule_rows
from pagewright.plans.registry import register
from pagewright.plans.session import table
from pagewright.plans.url_queries import SQL_LINKS, SQL_URLS, page_links

_TEXT = r"trim(regexp_replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))"


@register(
    "page_extract",
    rf"""WITH x AS (SELECT page_id, html, list_zip(regexp_extract_all(html, '(?is)<h([1-6])[^>]*>.*?</h[1-6]>', 1), regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1)) AS hs,
  regexp_extract(html, '(?is)<head[^>]*>(.*?)</head>', 1) AS head, regexp_extract(html, '(?is)<body[^>]*>(.*?)(?:</body>|$)', 1) AS body FROM pages)
SELECT page_id, {_TEXT.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
 array_to_string(list_filter(list_transform(hs, lambda h: h[1] || ':' || left({_TEXT.format("h[2]")}, 256)), lambda t: length(t) > 2), '|') AS headings,
 len(regexp_extract_all(html, '(?i)<a\b[^>]*href="([^"]+)"', 1)) AS n_links, len(regexp_extract_all(html, '(?i)<img\b[^>]*>')) AS n_images,
 md5(left(head || left(body, 2048), 8192)) AS snippet_md5, strlen(html) > 2000 AS truncated, len(regexp_extract_all(html, '<[a-zA-Z]')) AS n_elements,
 regexp_matches(html, '(?i)<input\b[^>]*type="password"') AS has_password FROM x""",
)
def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    shown = F.array_join(F.transform(H.headings(html), lambda h: F.concat_ws(":", h["level"].cast("string"), h["text"])), "|")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        H.title(html).alias("title"),
        shown.alias("headings"),
        F.size(H.links(html)).alias("n_links"),
        F.size(H.images(html)).alias("n_images"),
        F.md5(H.snippet(html)).alias("snippet_md5"),
        H.capped(html, 2000)["truncated"].alias("truncated"),
        F.size(F.regexp_extract_all(html, F.lit("<[a-zA-Z]"), F.lit(0))).alias("n_elements"),
        H.has_password(html).alias("has_password"),
    )


@register(
    "page_classes",
    r"""WITH c AS (SELECT page_id, list_filter(flatten(list_transform(regexp_extract_all(html, 'class="([^"]*)"', 1), lambda t: string_split_regex(t, '\s+'))), lambda t: t <> '') AS cs, regexp_extract_all(html, '(?:href|src|action)="([^"]+)"', 1) AS us FROM pages)
SELECT page_id, coalesce(len(list_distinct(cs)), 0) AS n_classes, coalesce(array_to_string(list_sort(list_distinct(cs)), ','), '') AS classes, len(list_distinct(list_filter(us, lambda u: trim(u) <> '' AND NOT regexp_matches(u, '^(data|javascript):')))) AS n_urls FROM c""",
)
def page_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", H.css_classes(F.col("html")).alias("c"), H.network_urls(F.col("html")).alias("u"))
    return found.select("page_id", F.size("c").alias("n_classes"), F.array_join(F.array_sort("c"), ",").alias("classes"), F.size("u").alias("n_urls"))


@register(
    "page_auth_states",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'unknown' WHEN event_id % 11 = 0 OR event_id % 7 = 1 THEN 'blocked' WHEN event_id % 5 = 0 OR event_id % 7 IN (2, 3) THEN 'auth_required' WHEN event_id % 3 = 0 THEN 'authenticated' ELSE 'public' END AS state FROM events""",
)
def page_auth_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    code = F.element_at(F.array(*map(F.lit, (200, 429, 401, 403, 200, 500, 200))), (e % 7 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", H.page_auth(F.col("event_type") == "error", e % 11 == 0, code, e % 5 == 0, e % 3 == 0).alias("state"))


@register("strip_trackers", "SELECT page_id, length(html) AS kept_chars, 0 AS left_over FROM pages")
def strip_trackers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a base element and tracker scripts put in, and taken out again."""
    bad = '<base href="/x"><script async src="https://www.googletagmanager.com/gtag/js?id=1"></script><SCRIPT src="//plausible.io/js/p.js">x</SCRIPT>'
    clean = H.without_trackers(F.replace(F.col("html"), F.lit("<body>"), F.lit("<body>" + bad)))
    got = table(spark, sf_dir, "pages").select("page_id", clean.alias("c"))
    return got.select("page_id", F.length("c").alias("kept_chars"), F.size(F.regexp_extract_all("c", F.lit("googletagmanager|plausible"), F.lit(0))).alias("left_over"))


@register(
    "css_tokens",
    """SELECT p_partkey, '--a-1=#' || p_size || ',--gap=' || p_size || 'px' AS variables, CASE WHEN p_size + 600 = 640 THEN '640' ELSE least(640, p_size + 600) || ',' || greatest(640, p_size + 600) END AS breakpoints FROM part""",
)
def css_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    css = F.concat(F.lit(":root{--gap: "), size, F.lit("px; --a-1:#"), size, F.lit("} @media (min-width: 640px) {a{}} @media (max-width: "), (F.col("p_size") + 600).cast("string"), F.lit("px) and (min-width:640px) {b{--gap:0}}"))
    shown = F.array_join(F.transform(F.map_entries(H.css_variables(css)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return table(spark, sf_dir, "part").select("p_partkey", shown.alias("variables"), F.array_join(H.breakpoints(css), ",").alias("breakpoints"))


def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as rows of scans, a host being a scan."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(U.url_parts(F.col("url"))["host"].alias("scan_id"), F.col("page_id").alias("page_seq"), F.col("url").alias("page_url"), "html")


#: Rules that the test pages can match, in place of the built-in ones.
CORPUS_RULES = (
    ("inline-tracker", "Inline tracker", "Analytics & Tracking", (("htmlRegex", "regex", r"track\(", 0.6, None, "exact"), ("cssClasses", "regex", "^ad$", 0.5, None, "exact"))),
    ("doc-links", "Links", "CMS", (("networkRequests", "regex", r"^/the", 0.55, None, "exact"),)),
    ("charset-only", "Charset", "CMS", (("htmlRegex", "regex", 'charset="utf-8"', 0.4, None, "exact"),)),
)


@register(
    "detect_technologies",
    r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS scan_id, left(regexp_extract(html, '(?is)<head[^>]*>(.*?)</head>', 1) || left(regexp_extract(html, '(?is)<body[^>]*>(.*?)(?:</body>|$)', 1), 2048), 8192) AS s FROM pages),
m AS (SELECT scan_id, page_id, url, 'inline-tracker' AS id, 0.6 AS w, 0 AS seq, 'htmlRegex' AS vector FROM p WHERE regexp_matches(s, '(?i)track\(')
 UNION ALL SELECT scan_id, page_id, url, 'inline-tracker', 0.5, 1, 'cssClasses' FROM p WHERE regexp_matches(s, 'class="([^"]*\s)?(?i:ad)(\s[^"]*)?"')
 UNION ALL SELECT scan_id, page_id, url, 'doc-links', 0.55, 2, 'networkRequests' FROM p WHERE regexp_matches(s, '(href|src|action)="\s*(?i:/the)')),
sig AS (SELECT scan_id, id, seq, vector, w, min(page_id) AS f FROM m GROUP BY ALL),
pg AS (SELECT scan_id, id, count(DISTINCT page_id) AS n_pages, arg_min(url, page_id) AS first_page FROM m GROUP BY ALL)
SELECT sig.scan_id, sig.id AS technology_id, round(1 - product(1 - w), 6) AS confidence, CASE WHEN 1 - product(1 - w) >= 0.75 THEN 'detected' ELSE 'probable' END AS confidence_status,
string_agg(vector, ',' ORDER BY f, seq) AS vectors, least(any_value(n_pages), 100) AS n_pages, any_value(first_page) AS first_page FROM sig JOIN pg ON pg.scan_id = sig.scan_id AND pg.id = sig.id GROUP BY sig.scan_id, sig.id""",
)
def detect_technologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection per host with a rule set for this corpus."""
    rules = spark.createDataFrame(rule_rows(CORPUS_RULES), SCHEMA)
    found = D.detect_pages(scan_pages(spark, sf_dir), rules)
    return found.select("scan_id", "technology_id", "confidence", "confidence_status", F.array_join("vectors", ",").alias("vectors"), "n_pages", "first_page")


@register("detect_builtin")
def detect_builtin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in rules over the pages, with observed columns made of keys; the tests know what they give."""
    e = F.col("page_seq")
    seen = scan_pages(spark, sf_dir).withColumns(
        {
            "headers": F.when(e % 3 == 0, F.create_map(F.lit("Server"), F.lit("cloudflare"), F.lit("X-Powered-By"), F.lit("PHP/8.1.2"))).otherwise(F.create_map().cast("map<string,string>")),
            "js_globals": F.create_map(F.lit("React"), e % 2 == 0, F.lit("jQuery"), e % 5 == 0),
            "cookies": F.when(e % 4 == 0, F.array(F.lit("PHPSESSID"))).otherwise(F.array().cast("array<string>")),
            "markers": F.when(e % 7 == 0, F.array(F.lit("#__next"))).otherwise(F.array().cast("array<string>")),
        }
    )
    found = D.detect_pages(seen, builtin(spark))
    return found.withColumn("vectors", F.array_join("vectors", ","))


@register(
    "detection_totals",
    "WITH " + SQL_URLS + " SELECT host AS scan_id, count(*) AS pages_considered, count(*) FILTER (WHERE length(html) > 0) AS pages_with_evidence, bool_or(length(html) >= 20000) AS any_long FROM canon GROUP BY host",
)
def detection_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("html")
    return scan_pages(spark, sf_dir).groupBy("scan_id").agg(F.count("*").alias("pages_considered"), F.count_if(size > 0).alias("pages_with_evidence"), F.bool_or(size >= 20000).alias("any_long"))


@register(
    "link_graph",
    "WITH " + SQL_LINKS + " SELECT l.page_id, c.page_id AS target_id, count(*) AS n FROM links l JOIN canon c ON c.key = l.link GROUP BY ALL",
)
def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that lead to pages of the table."""
    keys = table(spark, sf_dir, "pages").select(F.col("page_id").alias("target_id"), U.normalize_url(F.col("url")).alias("link"))
    return page_links(spark, sf_dir).select("page_id", "link").join(keys, "link").groupBy("page_id", "target_id").agg(F.count("*").alias("n"))
