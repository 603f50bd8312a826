"""Rows of a scan: page records, failed pages, content strings, menus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import html as H
from pagewright.functions.columns import record
from pagewright.functions.text import slugify
from pagewright.functions.urls import CrawlScope, looks_like_login, path_for_url, resolve_url
from pagewright.operators.site import parents_by_depth, suffixed

#: Fixed values.
MOST_URL_CHARS, MOST_ALT_CHARS, MOST_MENU_DEPTH = 2048, 256, 10
USER_LABEL = r"(?i)sign in|sign out|log in|logout|log out|profile|account|settings|dashboard|my account"


def split_links(links: Column, base: Column, scope: CrawlScope, seed: Column) -> Column:
    """Struct (internal, external) of the resolved, distinct links of a page, in their order."""
    found = F.array_distinct(F.filter(F.transform(links, lambda x: resolve_url(base, x)), lambda u: u.isNotNull() & (F.length(u) <= MOST_URL_CHARS)))
    inside = lambda u: scope.classify(u, seed) == "internal"
    return F.transform(F.array(found), lambda f: record(internal=F.filter(f, inside), external=F.filter(f, lambda u: ~inside(u))))[0]


def resolved_images(images: Column, base: Column, scope: CrawlScope, seed: Column) -> Column:
    """Array of (src, alt, internal): sources resolved, of equal ones the first."""
    made = F.transform(images, lambda i: record(src=resolve_url(base, i["src"]), alt=F.substring(F.trim(i["alt"]), 1, MOST_ALT_CHARS)))
    first = lambda a, x: F.when(x["src"].isNull() | (F.length(x["src"]) > MOST_URL_CHARS) | F.exists(a, lambda y: y["src"] == x["src"]), a).otherwise(F.concat(a, F.array(x)))
    kept = F.aggregate(made, F.array().cast("array<struct<src:string,alt:string>>"), first)
    return F.transform(kept, lambda i: record(src=i["src"], alt=i["alt"], internal=scope.classify(i["src"], seed) == "internal"))


def page_records(pages: DataFrame, scope: CrawlScope | None = None) -> DataFrame:
    """One record per page from page_id, url, final_url and html; each page's own URL is the seed of its scope.

    A null html gives the record of a page that could not be read.
    """
    scope, url, html = scope or CrawlScope(), F.col("final_url"), F.coalesce("html", F.lit(""))
    meta = H.meta_tags(html)
    links = split_links(H.links(html), url, scope, url)
    rows = pages.select(
        "page_id",
        "url",
        "final_url",
        path_for_url(url).alias("path"),
        F.nullif(H.title(html), F.lit("")).alias("title"),
        meta["description"].alias("meta_description"),
        meta["robots"].alias("robots_meta"),
        H.headings(html).alias("headings"),
        links.alias("links"),
        resolved_images(H.images(html), url, scope, url).alias("images"),
        F.when(F.col("html").isNull(), "failed").otherwise("completed").alias("status"),
        (looks_like_login(url) & ~looks_like_login(F.col("url"))).alias("redirected_to_login"),
    )
    warnings = F.filter(F.array(F.when((F.size("headings") == 0) & (F.col("status") == "completed"), "missing_headings")), lambda w: w.isNotNull())
    return rows.withColumns({"internal_links": F.col("links.internal"), "external_links": F.col("links.external"), "warnings": warnings}).drop("links")


def content_strings(headings: DataFrame, site: str = "site") -> DataFrame:
    """Texts of a site by key, from rows (site, path, page_id, position, level, section, text): (site, key, text).

    A key names the page, the section and the heading; of equal keys the second and later have a number.
    """
    page = F.when(F.col("path") == "/", "home").otherwise(F.coalesce(F.nullif(slugify(F.col("path")), F.lit("")), F.lit("page")))
    field = F.when((F.col("level") == 1) & (F.col("position") == 0), "title").otherwise(F.concat_ws("_", F.lit("heading"), F.col("level").cast("string"), (F.col("position") + 1).cast("string")))
    rows = headings.where("trim(text) <> ''").withColumn("_key", F.concat_ws(".", page, "section", field))
    return suffixed(rows, [site], "_key", ["path", "page_id", "position"], "_").select(site, F.col("unique_name").alias("key"), "text")


def requires_auth(href: Column, guarded: Column) -> Column:
    """Whether a link leads to or below one of the ``guarded`` patterns; a pattern's last parameter is open."""
    path = F.when(href.rlike("(?i)^https?://"), path_for_url(href)).otherwise(F.regexp_extract(href, "^[^?#]*", 0))
    return F.exists(guarded, lambda g: (path == g) | F.startswith(path, F.concat(F.regexp_replace(g, "/:[^/]+$", ""), F.lit("/"))))


def menus(items: DataFrame, site: str = "site") -> DataFrame:
    """Menu items of a site from rows (site, page, region, seq, href, text, depth): (site, menu, page, seq, label, href, parent_seq).

    An item's parent is the last one before it in its region that lies higher.
    Labels of a visitor's own pages are the user's menu, a footer's items the
    footer's, others the primary one; of top items with one target in one menu
    the first stays, and what hangs below a dropped item has no parent there.
    """
    label = F.when(F.col("text") != "", F.col("text")).otherwise(F.col("href"))
    rows = items.where("href <> '' OR text <> ''").withColumns({"label": label, "depth": F.least(F.greatest(F.col("depth"), F.lit(0)), F.lit(MOST_MENU_DEPTH - 1))})
    nested = parents_by_depth(rows, [site, "page", "region"], "seq", "depth", MOST_MENU_DEPTH)
    menu = F.when(F.col("label").rlike(USER_LABEL), "user").when(F.lower("region") == "footer", "footer").otherwise("primary")
    placed = nested.withColumn("menu", menu)
    number = F.row_number().over(Window.partitionBy(site, "menu", F.when(F.col("parent_seq").isNull(), F.col("href")).otherwise(F.concat_ws("#", F.lit(""), "page", "region", F.col("seq").cast("string")))).orderBy("page", "region", "seq"))
    return placed.withColumn("_n", number).where("_n = 1").select(site, "menu", "page", "region", "seq", "label", "href", "parent_seq")
