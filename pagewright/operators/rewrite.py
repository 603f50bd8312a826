"""Offline copies: references in pages and style sheets turned to local files.

References are rows: those of all pages are exploded and joined with the files of
their scan, so a page meets only the files it names.  What is found comes back as
one map per page, and the markup is rewritten by column expressions: cut at its
tags, each tag at its attributes, and put together again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.columns import let
from pagewright.functions.html import TRACKER_HOSTS
from pagewright.functions.text import relative_prefix
from pagewright.functions.urls import resolve_url

TAG = r"<[a-zA-Z][a-zA-Z0-9-]*[^>]*>"
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s>"']+)"""
LINKING = rf"(?i)\b(?:src|href|poster|data-src)\s*=\s*{_VALUE}"
SRCSET = r"""(?i)\bsrcset\s*=\s*(?:"[^"]*"|'[^']*')"""
CSS_URL = r"""(?i)url\(\s*(?:"[^"]*"|'[^']*'|[^'")]*)\s*\)"""


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def replaced(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """``text`` with every match of ``pattern`` put through ``change``."""
    gaps, hits = F.split(text, pattern, -1), F.transform(_all(text, pattern), change)
    return F.array_join(F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(h, F.lit("")))), "")


def value_of(attribute: Column) -> Column:
    """What stands behind the equals sign, without quotes."""
    return F.trim(F.regexp_replace(F.regexp_extract(attribute, r"(?s)^[^=]*=\s*(.*)$", 1), r"""^["']|["']$""", ""))


def source_set(value: Column) -> Column:
    """The URLs of a set of image sources."""
    return F.transform(F.split(value, ","), lambda x: F.substring_index(F.trim(x), " ", 1))


def references(html: Column) -> Column:
    """Distinct references of a page, as they are written."""
    plain = F.transform(_all(html, LINKING), value_of)
    sets = F.flatten(F.transform(_all(html, SRCSET), lambda a: source_set(value_of(a))))
    styles = F.transform(_all(html, CSS_URL), css_target)
    return F.array_distinct(F.filter(F.concat(plain, sets, styles), lambda r: (r != "") & ~r.rlike("^(?:data:|#)")))


def css_target(match: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(match, r"(?s)\(\s*(.*?)\s*\)$", 1), r"""^["']|["']$""", ""))


def asset_urls(html: Column, base: Column) -> Column:
    """Distinct (url, kind) of what a page loads: style sheets, scripts, images, media, style values and icons, in this order."""
    tags = lambda pattern: _all(html, rf"(?i)<(?:{pattern})\b[^>]*>")
    attribute = lambda t, name: value_of(F.regexp_extract(t, rf"(?i)\b{name}\s*=\s*{_VALUE}", 0))
    typed = lambda urls, kind: F.transform(urls, lambda u: F.named_struct(F.lit("url"), resolve_url(base, u), F.lit("kind"), F.lit(kind)))
    of = lambda pattern, name: F.transform(tags(pattern), lambda t: attribute(t, name))
    linked = lambda rel: F.transform(F.filter(tags("link"), lambda t: attribute(t, "rel").rlike(rf"(?i)(^|\s)(?:{rel})(\s|$)")), lambda t: attribute(t, "href"))
    sets = F.flatten(F.transform(of("img|source", "srcset"), source_set))
    styles = F.transform(F.flatten(F.transform(of("[a-z][a-z0-9-]*", "style"), lambda s: _all(s, CSS_URL))), css_target)
    parts = [typed(linked("stylesheet"), "stylesheet"), typed(of("script", "src"), "script"), typed(of("img", "src"), "image"), typed(sets, "image"), typed(of("source|video|audio", "src"), "other"), typed(styles, "font"), typed(linked("icon|manifest"), "image")]
    first = lambda a, x: F.when(x["url"].isNull() | F.exists(a, lambda y: y["url"] == x["url"]), a).otherwise(F.concat(a, F.array(x)))
    return F.aggregate(F.concat(*parts), F.array().cast("array<struct<url:string,kind:string>>"), first)


def local_files(pages: DataFrame, files: DataFrame, key: str = "page_id") -> DataFrame:
    """Per page key the map from a reference as written to the local file it means.

    ``pages`` has scan_id, the key, url and html; ``files`` has scan_id, url (canonical)
    and file.  Of several files of one URL the smallest counts.
    """
    refs = pages.select("scan_id", key, F.col("url").alias("_base"), F.explode(references(F.col("html"))).alias("ref"))
    asked = refs.select("scan_id", key, "ref", resolve_url(F.col("_base"), F.col("ref")).alias("target")).where("target IS NOT NULL")
    one = files.groupBy("scan_id", F.col("url").alias("target")).agg(F.min("file").alias("file"))
    met = asked.join(one, ["scan_id", "target"])
    return met.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ref", "file")))).alias("local"))


def _tag(local: Column, prefix: Column) -> Callable[[Column], Column]:
    """What a tag becomes: known references local; links that leave the copy open apart."""

    def target(ref: Column) -> Column:
        return F.when(local[ref].isNotNull(), F.concat(prefix, local[ref], F.regexp_extract(ref, "#.*$", 0)))

    def linked(attribute: Column) -> Column:
        name = F.regexp_extract(attribute, r"(?s)^[^=]*=", 0)
        return let(target(value_of(attribute)), lambda t: F.when(t.isNotNull(), F.concat(name, F.lit('"'), t, F.lit('"'))).otherwise(attribute))

    def sources(attribute: Column) -> Column:
        one = lambda x: let(F.trim(x), lambda e: F.concat_ws(" ", F.coalesce(target(F.substring_index(e, " ", 1)), F.substring_index(e, " ", 1)), F.nullif(F.regexp_extract(e, r"^\S+\s+(.*)$", 1), F.lit(""))))
        return F.concat(F.lit('srcset="'), F.array_join(F.transform(F.split(value_of(attribute), ","), one), ", "), F.lit('"'))

    def change(tag: Column) -> Column:
        known = replaced(tag, LINKING, linked)
        outside = tag.rlike(r"(?i)^<a\b") & tag.rlike(r"""(?i)\bhref\s*=\s*["']?\s*https?://""") & ~tag.rlike(r"(?i)\btarget\s*=")
        stays = let(value_of(F.regexp_extract(tag, rf"(?i)\bhref\s*=\s*{_VALUE}", 0)), lambda v: local[v].isNull())
        opened = F.when(outside & stays, F.concat(F.regexp_replace(known, ">$", ""), F.lit(' target="_blank" rel="noopener noreferrer">'))).otherwise(known)
        return F.when(tag.rlike(SRCSET), replaced(opened, SRCSET, sources)).otherwise(opened)

    return change


def rewritten_pages(pages: DataFrame, files: DataFrame, client: str = "mock-client.js", key: str = "page_id") -> DataFrame:
    """``pages`` with html as an offline copy has it; ``file`` names each page's own place in the copy.

    Base elements and the scripts of trackers go, references to files of the copy
    become relative, and the copy's client is loaded at the end of the head.
    Null pages stay null; pages of a scan without files keep their references.
    """
    hosts = "|".join(h.replace(".", r"\.") for h in TRACKER_HOSTS)
    tracker = rf"""(?is)<script\b[^>]*\bsrc\s*=\s*["']?[^"'\s>]*(?:{hosts})[^>]*>\s*</script>"""
    joined = pages.join(local_files(pages, files, key), key, "left").withColumn("local", F.coalesce("local", F.create_map().cast("map<string,string>")))
    plain = F.regexp_replace(F.regexp_replace("html", r"(?i)<base\b[^>]*>", ""), tracker, "")
    prefix = relative_prefix(F.col("file"))
    body = replaced(plain, TAG, _tag(F.col("local"), prefix))
    script = F.concat(F.lit('<script src="'), prefix, F.lit(client), F.lit('"></script>'))
    before = lambda h, end: F.concat(F.regexp_extract(h, rf"(?is)^(.*?){end}", 1), script, F.regexp_extract(h, rf"(?is)^.*?({end}.*)$", 1))
    placed = let(body, lambda h: F.when(h.rlike("(?i)</head>"), before(h, "</head>")).when(h.rlike("(?i)</body>"), before(h, "</body>")).otherwise(F.concat(h, script)))
    return joined.withColumn("html", placed).drop("local")


def rewritten_css(css: Column, local: Column, prefix: Column) -> Column:
    """A style sheet whose targets in the map ``local`` are relative; only its first charset rule stays."""
    rule = r"""(?i)@charset\s+(?:"[^"]*"|'[^']*')\s*;"""
    first = F.regexp_extract(css, rule, 0)
    once = F.when(first != "", let(F.instr(css, first) + F.length(first), lambda at: F.concat(F.substring(css, F.lit(1), at - 1), F.regexp_replace(F.substring(css, at, F.lit(1_000_000_000)), rule, "")))).otherwise(css)

    def change(match: Column) -> Column:
        known = let(css_target(match), lambda t: F.coalesce(local[t], local[F.regexp_replace(t, "^/", "")], local[F.regexp_replace(t, r"^\./", "")]))
        quote = let(F.regexp_extract(match, r"""\(\s*(["'])""", 1), lambda q: F.when(q == "", F.lit("'")).otherwise(q))
        return F.when(css_target(match).rlike("^(?:data:|#)"), match).otherwise(let(known, lambda k: F.when(k.isNull(), match).otherwise(F.concat(F.lit("url("), quote, prefix, k, quote, F.lit(")")))))

    return let(once, lambda c: replaced(c, CSS_URL, change))
