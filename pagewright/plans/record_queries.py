"""Queries on page records, content, menus and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import html as H
from pagewright.functions import urls as U
from pagewright.operators import records as R
from pagewright.plans.registry import register
from pagewright.plans.session import table
from pagewright.plans.url_queries import SQL_LINKS
from pagewright.streaming import requests as Q


@register(
    "page_records",
    "WITH "
    + SQL_LINKS
    + """, n AS (SELECT page_id, count(DISTINCT link) AS n FROM links GROUP BY 1)
SELECT c.page_id, c.path, CASE WHEN c.page_id % 10 = 3 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN c.page_id % 10 = 3 THEN 0 ELSE coalesce(n.n, 0) + 1 END AS n_internal, CASE WHEN c.page_id % 10 = 3 THEN 0 ELSE 1 END AS n_external,
CASE WHEN c.page_id % 10 = 3 THEN '' ELSE 'https://img.example/b.png:x:false' END AS images FROM canon c LEFT JOIN n ON n.page_id = c.page_id""",
)
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of pages with some links and an image put in; every tenth page could not be read."""
    extra = '<body><a href="#top">t</a><a href="https://out.example/">o</a><a href="https://out.example/?utm_source=x">o</a><a href="mailto:a@b">m</a><img src="https://img.example/b.png" alt=" x "><img src="https://img.example/b.png#2" alt="y">'
    html = F.when(F.col("page_id") % 10 != 3, F.replace(F.col("html"), F.lit("<body>"), F.lit(extra)))
    rows = R.page_records(table(spark, sf_dir, "pages").select("page_id", "url", F.col("url").alias("final_url"), html.alias("html")))
    shown = F.array_join(F.transform("images", lambda i: F.concat_ws(":", i["src"], i["alt"], i["internal"].cast("string"))), ",")
    return rows.select("page_id", "path", "status", F.size("internal_links").alias("n_internal"), F.size("external_links").alias("n_external"), shown.alias("images"))


@register(
    "site_strings",
    r"""WITH h AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS site, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, unnest(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)) AS t FROM pages),
k AS (SELECT *, CASE WHEN path = '/' THEN 'home' ELSE left(regexp_replace(regexp_replace(lower(path), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 64) END || '.main.title' AS key FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY site, key ORDER BY path, page_id) AS n FROM k) SELECT site, key || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS key, md5(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS digest FROM n""",
)
def site_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(U.url_parts(F.col("url"))["host"].alias("site"), U.path_for_url(F.col("url")).alias("path"), "page_id", F.posexplode(H.headings(F.col("html"))).alias("position", "h"))
    rows = pages.select("site", "path", "page_id", "position", F.col("h.level").alias("level"), F.lit("main").alias("section"), F.col("h.text").alias("text")).where("level = 1")
    return R.content_strings(rows).select("site", "key", F.md5("text").alias("digest"))


@register(
    "site_menus",
    """WITH i AS (SELECT user_id AS site, event_id AS seq, CASE WHEN event_type = 'error' THEN 'account' ELSE 'x' || (event_id % 7) END AS label, '/' || (event_id % 7) AS href, event_id % 2 AS depth, CASE WHEN event_id % 3 = 0 THEN 'footer' ELSE 'nav' END AS region FROM events),
p AS (SELECT a.site, a.seq, a.label, a.href, a.region, max(b.seq) AS parent_seq FROM i a LEFT JOIN i b ON a.site = b.site AND a.region = b.region AND b.seq < a.seq AND b.depth < a.depth GROUP BY ALL),
m AS (SELECT *, CASE WHEN label = 'account' THEN 'user' WHEN region = 'footer' THEN 'footer' ELSE 'primary' END AS menu FROM p)
SELECT site, menu, seq, label, href, parent_seq FROM m QUALIFY parent_seq IS NOT NULL OR row_number() OVER (PARTITION BY site, menu, href, parent_seq IS NULL ORDER BY region, seq) = 1""",
)
def site_menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as menu items of their user's site."""
    e = F.col("event_id")
    target = (e % 7).cast("string")
    items = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("site"), F.lit(0).alias("page"), F.when(e % 3 == 0, "footer").otherwise("nav").alias("region"), e.alias("seq"), F.concat(F.lit("/"), target).alias("href"), F.when(F.col("event_type") == "error", "account").otherwise(F.concat(F.lit("x"), target)).alias("text"), (e % 2).cast("int").alias("depth")
    )
    return R.menus(items).select("site", "menu", "seq", "label", "href", "parent_seq")


@register(
    "request_outcomes",
    """WITH s AS (SELECT event_id // 2 AS k, min(ts) FILTER (WHERE event_id % 2 = 0) AS asked, min(ts) FILTER (WHERE event_id % 2 = 1 AND value >= 20) AS replied FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events)
SELECT k::VARCHAR AS id, CASE WHEN asked IS NULL THEN 'unasked' WHEN replied <= asked + INTERVAL 5 MINUTE THEN 'answered' WHEN replied IS NOT NULL OR now > asked + INTERVAL 5 MINUTE THEN 'timed_out' ELSE 'pending' END AS outcome FROM s, n""",
)
def request_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in pairs as requests and replies; a reply of low value is lost."""
    kind = F.when(F.col("event_id") % 2 == 0, "ask").when(F.col("value") < 20, "lost").otherwise("reply")
    made = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 2).cast("string").alias("id"), "ts", kind.alias("kind"))
    return Q.outcomes(made).select("id", "outcome")


@register(
    "event_outcomes",
    """WITH s AS (SELECT event_id // 2 AS k, min(ts) FILTER (WHERE event_id % 2 = 0) AS asked, min(ts) FILTER (WHERE event_id % 2 = 1 AND event_type IS DISTINCT FROM 'error') AS replied FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events)
SELECT k::VARCHAR AS id, CASE WHEN asked IS NULL THEN 'unasked' WHEN replied <= asked + INTERVAL 5 MINUTE THEN 'answered' WHEN replied IS NOT NULL OR now > asked + INTERVAL 5 MINUTE THEN 'timed_out' ELSE 'pending' END AS outcome FROM s, n""",
)
def event_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in pairs as requests and replies; a reply that is an error is lost."""
    kind = F.when(F.col("event_id") % 2 == 0, "ask").when(F.col("event_type") == "error", "lost").otherwise("reply")
    made = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 2).cast("string").alias("id"), "ts", kind.alias("kind"))
    return Q.outcomes(made).select("id", "outcome")
