"""Plans and summaries over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import planning as P
from pagewright.plans.registry import register
from pagewright.plans.session import table


def _page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages of customers: their state, depth and path follow from status, priority and date."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("skipped")
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 100).alias("site"), F.col("o_orderkey").alias("page_id"), status.alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("depth"),
        F.concat(F.lit("/"), F.col("o_orderdate").cast("date").cast("string")).alias("path"), F.concat(F.lit("https://x/"), F.col("o_orderkey").cast("string")).alias("url"),
    )


@register(
    "source_urls",
    """SELECT o_custkey % 100 AS site, 'https://x/' || arg_min(o_orderkey, {'d': CAST(left(o_orderpriority, 1) AS INTEGER), 'p': CAST(o_orderdate AS DATE), 'k': o_orderkey}) AS source_url FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""",
)
def source_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each site's completed pages begin."""
    return P.source_urls(P.eligible_pages(_page_rows(spark, sf_dir)), "site")


@register(
    "synthesis_targets",
    """WITH c AS (SELECT p_type AS site, p_partkey AS id, p_size AS place FROM part), w AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity > 45)
SELECT site, id FROM c WHERE id IN (SELECT id FROM w) QUALIFY row_number() OVER (PARTITION BY site ORDER BY place, id) <= 50""",
)
def synthesis_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty parts of each kind that have been ordered in large numbers."""
    parts = table(spark, sf_dir, "part").select(F.col("p_type").alias("site"), F.col("p_partkey").alias("id"), F.col("p_size").alias("place"))
    large = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return P.targets(parts, "site", "place", parts.select("site", "id").join(large, "id", "left_semi")).select("site", "id")


@register(
    "nation_profiles",
    """WITH w AS (SELECT DISTINCT s_nationkey AS nation, r_name AS name FROM supplier JOIN region ON r_regionkey = s_suppkey % 7)
SELECT n_nationkey AS nation, r_name AS name, r_regionkey AS place FROM nation CROSS JOIN region WHERE n_nationkey NOT IN (SELECT nation FROM w) OR (n_nationkey, r_name) IN (SELECT (nation, name) FROM w)""",
)
def nation_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as profiles: nations have those that their suppliers name, or all."""
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("place"))
    asked = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 7).alias("place")).join(regions, "place")
    return P.resolved_profiles(regions, asked, "nation", table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation")))


@register(
    "capture_comparisons",
    """WITH o AS (SELECT DISTINCT c_nationkey AS nation, c_mktsegment AS profile FROM customer WHERE c_acctbal > 0), g AS (SELECT DISTINCT s_nationkey AS nation, c_mktsegment AS profile FROM supplier JOIN customer ON c_custkey = s_suppkey)
SELECT n_nationkey AS nation, p.profile AS profile, CASE WHEN o.nation IS NULL THEN 'original_unavailable' WHEN g.nation IS NULL THEN 'generated_unavailable' END AS skipped_reason
FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS profile FROM customer) p LEFT JOIN o ON o.nation = n_nationkey AND o.profile = p.profile LEFT JOIN g ON g.nation = n_nationkey AND g.profile = p.profile""",
)
def capture_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as profiles of nations: which have both an original and a generated capture."""
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    profiles = customer.select(F.col("c_mktsegment").alias("profile")).distinct()
    wanted = P.resolved_profiles(profiles, None, "nation", table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation")), "profile")
    own = customer.where("c_acctbal > 0").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("profile"), F.col("c_name").alias("path"))
    made = supplier.join(customer, F.col("s_suppkey") == F.col("c_custkey")).select(F.col("s_nationkey").alias("nation"), F.col("c_mktsegment").alias("profile"), F.col("s_name").alias("path"))
    return P.comparisons(wanted, own, made, ["nation", "profile"]).select("nation", "profile", "skipped_reason")


@register(
    "diff_totals",
    """SELECT l_suppkey AS report, count(*) AS viewports, count(*) FILTER (WHERE l_linestatus = 'F') AS compared, count(*) FILTER (WHERE l_linestatus <> 'F') AS skipped,
floor(coalesce(avg(100 - l_quantity) FILTER (WHERE l_linestatus = 'F'), 0) * 100 + 0.5) / 100 AS similarity, CAST(coalesce(sum(l_partkey) FILTER (WHERE l_linestatus = 'F'), 0) AS BIGINT) AS mismatched, CAST(coalesce(sum(l_orderkey) FILTER (WHERE l_linestatus = 'F'), 0) AS BIGINT) AS total,
bool_or(l_linestatus <> 'F' OR l_returnflag = 'R') AS partial FROM lineitem GROUP BY 1""",
)
def diff_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as compared captures of a supplier's report."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("report"), (F.col("l_linestatus") == "F").alias("compared"), (100 - F.col("l_quantity")).cast("double").alias("similarity"), F.col("l_partkey").alias("mismatched"), F.col("l_orderkey").alias("total"), (F.col("l_returnflag") == "R").alias("resized")
    )
    return P.diff_totals(rows, "report")


@register("new_documents", "SELECT p_partkey, p_brand, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM part s WHERE s.p_size > 25 AND s.p_brand = part.p_brand AND lower(s.p_name) = lower(part.p_name))")
def new_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name no large part of their brand has, their names written in capitals."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    sources = part.where("p_size > 25").select("p_brand", F.upper("p_name").alias("p_name"))
    return P.documents_not_in(part.select("p_partkey", "p_brand", "p_name"), sources, "p_brand", "p_name")


@register(
    "document_plans",
    """WITH c AS (SELECT c_nationkey AS site, r_name AS name, bool_and(CASE WHEN c_mktsegment = 'BUILDING' THEN true WHEN c_mktsegment = 'MACHINERY' THEN false END) AS inc, bool_or(c_acctbal < -900) AS exc, bool_or(c_acctbal > 9900) AS rel
  FROM customer JOIN region ON r_regionkey = c_custkey % 5 GROUP BY 1, 2)
SELECT s.site, r_name AS name, r_regionkey = 0 AS required, CASE WHEN r_regionkey = 0 THEN CASE WHEN coalesce(inc, true) THEN 'required' END WHEN coalesce(exc, false) OR NOT coalesce(inc, true) THEN NULL WHEN coalesce(inc, false) THEN 'opted_in' WHEN coalesce(rel, false) THEN 'relevant' END AS reason
FROM (SELECT DISTINCT site FROM c) s CROSS JOIN region LEFT JOIN c ON c.site = s.site AND c.name = r_name""",
)
def document_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as documents, one of them required; customers say which of them a nation wants, refuses or needs."""
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), (F.col("r_regionkey") == 0).alias("required"), F.col("r_regionkey").alias("place"))
    segment = F.col("c_mktsegment")
    said = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("site"), (F.col("c_custkey") % 5).alias("place"), F.when(segment == "BUILDING", True).when(segment == "MACHINERY", False).alias("include"), (F.col("c_acctbal") < -900).alias("exclude"), (F.col("c_acctbal") > 9900).alias("relevant"))
    return P.planned_documents(regions, said.join(regions.select("name", "place"), "place"), "site")


@register("file_groups", "SELECT p_size % 5 AS project, CASE WHEN p_size % 7 = 0 THEN '(root)' ELSE p_brand END AS name, count(*) AS n FROM part GROUP BY 1, 2")
def file_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select((F.col("p_size") % 5).alias("project"), F.when(F.col("p_size") % 7 == 0, F.col("p_name")).otherwise(F.concat_ws("/", "p_brand", "p_type", "p_name")).alias("path"))
    return P.top_level_groups(rows, "project")


@register("session_expiries", "SELECT user_id, min(value) FILTER (WHERE value - 50 > 0 AND event_type <> 'error') - 50 AS expires FROM events GROUP BY 1")
def session_expiries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cookies: errors have no number, low values are cookies of the session."""
    at = F.when(F.col("event_type") == "error", float("nan")).otherwise(F.col("value") - 50)
    return P.session_expiry(table(spark, sf_dir, "events").select("user_id", at.alias("expires")), "user_id")


_STATE = "CASE event_type WHEN 'view' THEN 'loaded' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'auth_required' WHEN 'click' THEN 'queued' ELSE 'blocked' END"


@register("crawl_totals", f"SELECT user_id, count(*) AS discovered, count(*) FILTER (WHERE s <> 'queued') AS scanned, {', '.join(f'count(*) FILTER (WHERE s = {s!r}) AS {s}' for s in P.PAGE_STATES)} FROM (SELECT user_id, {_STATE} AS s FROM events) GROUP BY 1")
def crawl_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.crawl_totals(table(spark, sf_dir, "events").select("user_id", F.expr(_STATE).alias("status")), "user_id")


@register(
    "first_case_collisions",
    """WITH n AS (SELECT p_type, p_partkey, CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS path, row_number() OVER (PARTITION BY p_type, lower(p_name) ORDER BY p_partkey) AS k FROM part)
SELECT p_type, arg_min(path, p_partkey) AS path FROM n WHERE k = 2 GROUP BY 1""",
)
def first_case_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_type", "p_partkey", F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("path"))
    return P.first_of_case(rows, "p_type", "p_partkey")
