"""Queries through file sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions import urls as U
from pagewright.plans.registry import register
from pagewright.plans.session import scratch_path, table
from pagewright.sources import files as S


@register(
    "evidence_nodes",
    """SELECT CASE WHEN event_id % 10 = 7 THEN 'malformed' WHEN event_id % 10 = 8 THEN 'no_nodes' ELSE 'ok' END AS reason, count(*) AS n_pages,
CAST(sum(CASE WHEN event_id % 10 IN (7, 8) THEN 0 ELSE 1 END) AS BIGINT) AS n_nodes FROM events GROUP BY 1""",
)
def evidence_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence written as lines of JSON and read back; each good document has one node with an id and one without."""
    k = F.col("event_id") % 10
    node = F.array(F.struct(F.lit("n0").alias("id"), F.lit("div").alias("tag")), F.struct(F.lit(None).cast("string").alias("id"), F.lit("p").alias("tag")))
    good = F.to_json(F.struct(F.col("event_id").cast("string").alias("page_id"), node.alias("nodes")))
    line = F.when(k == 7, "{oops").when(k == 8, '{"page_id":"x"}').otherwise(good)
    path = scratch_path(spark, "evidence")
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    read = S.read_evidence(spark, path)
    nodes = S.coerce_nodes(read.where("reason IS NULL")).agg(F.count("*").alias("n")).select(F.lit("ok").alias("reason"), F.col("n").alias("n_nodes"))
    counts = read.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n_pages"))
    return counts.join(nodes, "reason", "left").withColumn("n_nodes", F.coalesce("n_nodes", F.lit(0)))


@register(
    "clone_manifests",
    """WITH f AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS scan_id, page_id FROM pages)
SELECT scan_id, '{"route_count":' || count(*) || ',"asset_count":0,"routes":[' || string_agg('"p' || lpad(page_id::VARCHAR, 6, '0') || '.html"', ',' ORDER BY page_id) || '],"assets":[]}' AS manifest FROM f GROUP BY 1""",
)
def clone_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(U.url_parts(F.col("url"))["host"].alias("scan_id"), F.concat(F.lit("p"), F.lpad(F.col("page_id").cast("string"), 6, "0"), F.lit(".html")).alias("file"))
    return S.manifest(rows, rows.limit(0))


@register(
    "archive_round_trip",
    """SELECT page_id % 20 AS scan, 'pages/p' || page_id || '.html' AS path, strlen(html) AS size FROM pages WHERE page_id % 20 <> 3""",
)
def archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages packed per scan, in as many volumes as they need, and unpacked; one scan has an unsafe path and no archive."""
    path = F.when(F.col("page_id") % 20 == 3, F.concat(F.lit("../p"), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("pages/p"), F.col("page_id").cast("string"), F.lit(".html")))
    rows = table(spark, sf_dir, "pages").select((F.col("page_id") % 20).alias("scan"), path.alias("path"), F.col("html").cast("binary").alias("content"))
    packed = S.archives(rows, "scan", volumes=True).where("archive IS NOT NULL")
    return S.read_archive(packed, "scan").drop("crc")


@register("asset_files", "SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def asset_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that occur more than once, with the first that has each."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    return rows.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


@register(
    "content_strings",
    r"""WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<p[^>]*>([^<]*)', 1)) AS t FROM pages), c AS (SELECT page_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM p)
SELECT page_id, count(*) AS n_blocks, max(length(t)) AS longest FROM c WHERE length(t) BETWEEN 120 AND 20000 GROUP BY 1""",
)
def content_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks of a page that are long enough to be content."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<p[^>]*>([^<]*)"), F.lit(1))
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("t")).select("page_id", T.collapse_whitespace(F.col("t")).alias("t"))
    return rows.where(F.length("t").between(120, 20000)).groupBy("page_id").agg(F.count("*").alias("n_blocks"), F.max(F.length("t")).alias("longest"))
