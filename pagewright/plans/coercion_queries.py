"""Documents held against typed paths, and orders by locale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import html as H
from pagewright.operators import order as O
from pagewright.plans.registry import register
from pagewright.plans.session import table
from pagewright.sources import coercion as V

#: Properties of events: a number; every error has a word in its place, every low value an end that is lost.
_PROPS = """SELECT event_id, json_extract_string(props, '$.k') AS k, event_type = 'error' AS wrong, value < 10 AS broken FROM events"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = F.regexp_replace("props", r"(\d+)", '"$1"')
    text = F.when(F.col("value") < 10, F.expr("left(props, length(props) - 1)")).when(F.col("event_type") == "error", wrong).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", text.alias("text"))


_EVENT_RULES = (("k", "number", True, None), ("note", "string", False, 10))


@register("event_properties", f"SELECT event_id, k FROM ({_PROPS}) WHERE NOT wrong AND NOT broken")
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties of events that are what they should be."""
    found = V.members(_events(spark, sf_dir), "event_id", "text", V.rule_table(spark, _EVENT_RULES))
    return V.accepted(found).select(F.col("key").alias("event_id"), F.col("value").alias("k"))


@register("event_property_report", f"SELECT event_id, CASE WHEN broken THEN '' ELSE 'k' END AS location, CASE WHEN broken THEN 'malformed' ELSE 'wrong_kind' END AS problem FROM ({_PROPS}) WHERE wrong OR broken")
def event_property_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = V.rule_table(spark, _EVENT_RULES)
    found = V.members(_events(spark, sf_dir), "event_id", "text", rules)
    return V.report(found, rules).select(F.col("key").alias("event_id"), "location", "problem")


_EVIDENCE_RULES = (("page_id", "string", True, None), ("title", "string", True, 30), ("links", "list", False, 4), ("links[]", "string", False, None), ("heads", "list", True, None))


@register(
    "evidence_report",
    r"""WITH p AS (SELECT page_id, html, len(regexp_extract_all(html, '(?i)<a\b[^>]*href="([^"]+)"')) AS n_links, length(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS n_title FROM pages)
SELECT page_id, 'page_id' AS location, 'wrong_kind' AS problem, 1 AS n FROM p UNION ALL SELECT page_id, 'title', 'too_long', n_title - 30 FROM p WHERE n_title > 30
UNION ALL SELECT page_id, 'links', 'excess', n_links - 4 FROM p WHERE n_links > 4 UNION ALL SELECT page_id, 'heads', 'missing', 1 FROM p""",
)
def evidence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of every page: its id is no text, titles and lists of links are bounded, its headings are named otherwise."""
    html = F.col("html")
    title = F.regexp_extract(html, "<title>([^<]*)</title>", 1)
    plain = title
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(sign))
    links = F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*href="([^"]+)"'), F.lit(1))
    text = F.to_json(F.struct("page_id", plain.alias("title"), links.alias("links"), H.headings(html).alias("headings"), F.lit("x").alias("unknown")))
    rules = V.rule_table(spark, _EVIDENCE_RULES)
    found = V.members(table(spark, sf_dir, "pages").select("page_id", text.alias("text")), "page_id", "text", rules)
    return V.report(found, rules).select(F.col("key").alias("page_id"), "location", "problem", F.col("n").cast("int").alias("n"))


@register(
    "names_by_locale",
    r"""WITH w AS (SELECT DISTINCT coalesce(lang, '') AS lang, regexp_extract(text, '[^\x20\x09-\x0D]+') AS name FROM documents WHERE text IS NOT NULL)
SELECT lang, name, row_number() OVER (PARTITION BY lang ORDER BY name COLLATE en, name) AS place, row_number() OVER (PARTITION BY lang ORDER BY name) AS by_code FROM w WHERE name <> ''""",
)
def names_by_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of all documents in the order of a reader, accents and capitals beside their letters, and of code points."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    words = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.regexp_extract("text", r"[^\x20\x09-\x0D]+", 0).alias("name")).where("name <> ''").distinct()
    return O.placed(O.placed(words, ["lang"], ["name"], "place"), ["lang"], ["name"], "by_code", collation=None)
