"""Queries on what is concluded of a site: technologies, tokens, component graphs, exports, generations, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import design as G
from pagewright.operators import documents as D
from pagewright.operators import technology as T
from pagewright.plans.registry import register
from pagewright.plans.session import table
from pagewright.streaming.events import code_violations

_CATEGORIES = ("Frontend Framework", "Analytics & Tracking", "CMS", "Backend Framework & Server", "JS Library & UI Utilities", "Hosting & PaaS", "Meta-Framework & SSR Engine")
_EXTRA = ("yarn", "vercel", "node", "bun", "docker")
#: Parts as technologies of their brand's site.
_SQL_TECH = (
    "tech AS (SELECT p_brand AS scan_id, 't' || p_partkey AS technology_id, p_partkey AS k, "
    + "CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CATEGORIES)) + " END AS category, "
    + "p_type || ' ' || CASE p_partkey % 5 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_EXTRA)) + " END AS name, "
    + "p_size / 50.0 AS confidence, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_size > 20 THEN 'detected' ELSE 'unknown' END AS confidence_status, "
    + "CASE WHEN p_partkey % 4 = 0 THEN 'x GTM-AB' || (1000 + p_partkey) ELSE 'none' END AS ev FROM part)"
)


def _technologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    of = lambda values, n: F.get(F.array(*map(F.lit, values)), (k % n).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("scan_id"),
        F.concat(F.lit("t"), k.cast("string")).alias("technology_id"),
        of(_CATEGORIES, 7).alias("category"),
        F.concat_ws(" ", "p_type", of(_EXTRA, 5)).alias("name"),
        (F.col("p_size") / 50.0).alias("confidence"),
        F.when(k % 3 == 0, None).when(F.col("p_size") > 20, "detected").otherwise("unknown").alias("confidence_status"),
        F.array(F.lit("y"), F.when(k % 4 == 0, F.concat(F.lit("x GTM-AB"), (k + 1000).cast("string"))).otherwise("none")).alias("evidence"),
        F.concat((k % 30).cast("string"), F.lit(".1")).alias("version"),
    )


@register(
    "technology_buckets",
    f"""WITH {_SQL_TECH}, b AS (SELECT *, CASE WHEN category IN ('Frontend Framework', 'Meta-Framework & SSR Engine') THEN 'frontend_framework' WHEN category LIKE 'Backend%' THEN 'runtime' WHEN category LIKE 'Analytics%' THEN 'analytics'
WHEN category LIKE 'Hosting%' THEN 'cdn' WHEN category LIKE 'JS%' THEN 'ui_libraries' END AS bucket FROM tech WHERE CASE WHEN confidence_status IS NULL THEN confidence >= 0.5 ELSE confidence_status = 'detected' END),
r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, bucket ORDER BY confidence DESC, name, technology_id) AS n FROM b WHERE bucket IS NOT NULL)
SELECT scan_id, bucket, string_agg(name, '|' ORDER BY n) AS names FROM r WHERE n = 1 OR bucket NOT IN ('frontend_framework', 'runtime', 'cdn') GROUP BY 1, 2""",
)
def technology_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.buckets(_technologies(spark, sf_dir)).select("scan_id", "bucket", F.array_join("names", "|").alias("names"))


@register("analytics_providers", f"WITH {_SQL_TECH} SELECT scan_id, technology_id AS provider, CASE WHEN k % 4 = 0 THEN substr(ev, 3) END AS container_id FROM tech WHERE category LIKE 'Analytics%' AND coalesce(confidence_status, '') <> 'unknown'")
def analytics_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.analytics(_technologies(spark, sf_dir))


@register(
    "build_advice",
    f"""WITH {_SQL_TECH} SELECT scan_id, coalesce(arg_min(k % 30, technology_id) FILTER (WHERE category LIKE 'Backend%' AND name LIKE '%node%') || '.x', '20.x') AS node_version,
CASE WHEN bool_or(name LIKE '%yarn%') THEN 'yarn' WHEN bool_or(name LIKE '%bun%') THEN 'bun' ELSE 'npm' END AS package_manager,
CASE WHEN bool_or(name LIKE '%vercel%') THEN 'vercel' WHEN bool_or(name LIKE '%docker%') THEN 'docker' ELSE 'static_spa' END AS target FROM tech GROUP BY 1""",
)
def build_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.build_advice(_technologies(spark, sf_dir)).drop("build_command")


@register(
    "color_tokens",
    """WITH v AS (SELECT p_brand AS site, 'shade.' || (p_partkey % 20) AS token, '--shade-' || (p_partkey % 20) AS name, '#' || p_size AS value FROM part WHERE p_partkey % 2 = 0),
n AS (SELECT DISTINCT site, token, arg_min(value, name) OVER (PARTITION BY site, token) AS value FROM (SELECT site, token, name, min(value) AS value FROM v GROUP BY ALL)),
s AS (SELECT p_brand AS site, CASE WHEN p_partkey % 3 = 0 THEN 'foreground' ELSE 'background' END AS role, '#' || (p_size % 9) AS value FROM part WHERE p_size % 9 > 0),
c AS (SELECT site, role, value, count(*) AS k FROM s GROUP BY ALL), best AS (SELECT site, role AS token, value FROM c QUALIFY row_number() OVER (PARTITION BY site, role ORDER BY k DESC, value) = 1),
roles AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.site = b.site AND (n.token = b.token OR n.value = b.value))), known AS (SELECT * FROM n UNION ALL SELECT * FROM roles),
rest AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY k DESC, value) AS place FROM c WHERE role = 'background' AND NOT EXISTS (SELECT 1 FROM known WHERE known.site = c.site AND known.value = c.value))
SELECT * FROM known UNION ALL SELECT site, 'color_' || place, value FROM rest WHERE place <= 100""",
)
def color_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    names = part.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("site"), F.concat(F.lit("--shade-"), (F.col("p_partkey") % 20).cast("string")).alias("name"), F.concat(F.lit("#"), F.col("p_size").cast("string")).alias("value"))
    one = names.groupBy("site", "name").agg(F.min("value").alias("value"))
    shade = F.when(F.col("p_size") % 9 > 0, F.concat(F.lit("#"), (F.col("p_size") % 9).cast("string"))).otherwise("transparent")
    styles = part.select(F.col("p_brand").alias("site"), F.when(F.col("p_partkey") % 3 == 0, "foreground").otherwise("background").alias("role"), shade.alias("value"))
    return G.color_tokens(one, styles)


@register(
    "font_stacks",
    """WITH s AS (SELECT p_brand AS site, p_type AS a, CASE WHEN p_size % 2 = 0 THEN 'mono' ELSE 'sans' END AS kind FROM part), c AS (SELECT site, kind, a, count(*) AS n, CASE kind WHEN 'mono' THEN a || ', Mono' ELSE '"' || a || '", Arial' END AS stack FROM s GROUP BY ALL),
f AS (SELECT site, kind, n, stack, unnest(CASE kind WHEN 'mono' THEN [a, 'Mono'] ELSE [a, 'Arial'] END) AS family, unnest([0, 1]) AS place FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY site, kind, family ORDER BY n DESC, stack, place) AS r FROM f) SELECT site, kind, string_agg(family, ',' ORDER BY n DESC, stack, place, family) AS families FROM o WHERE r = 1 GROUP BY 1, 2""",
)
def font_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    stack = F.when(F.col("p_size") % 2 == 0, F.concat("p_type", F.lit(", Mono"))).otherwise(F.concat(F.lit('"'), "p_type", F.lit('", Arial')))
    return G.font_families(table(spark, sf_dir, "part").select(F.col("p_brand").alias("site"), stack.alias("stack"))).withColumn("families", F.array_join("families", ","))


@register("graph_problems", "SELECT s_nationkey AS site, 'unknown_child' AS problem, s_suppkey AS id FROM supplier WHERE s_suppkey % 7 = 0 UNION ALL SELECT s_nationkey, 'cycle', s_suppkey FROM supplier WHERE s_suppkey % 7 = 1")
def graph_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as components: some with a child that is not there, some their own child."""
    k = F.col("s_suppkey")
    children = F.when(k % 7 == 0, F.array(-k - 1)).when(k % 7 == 1, F.array(k)).otherwise(F.array().cast("array<bigint>"))
    return D.graph_problems(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("site"), k.alias("id"), children.alias("children")))


@register(
    "export_plan",
    """SELECT l_suppkey AS project, count(*) AS n_files, CAST(sum(floor(l_quantity)) AS BIGINT) AS n_bytes, CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END AS n_missing,
CASE WHEN l_suppkey % 3 = 0 THEN 'missing_file' WHEN count(*) > 600 THEN 'too_many_files' WHEN sum(floor(l_quantity)) > 14000 THEN 'too_large' END AS reason FROM lineitem GROUP BY l_suppkey""",
)
def export_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    row = F.monotonically_increasing_id().cast("string")  # line items have no key of their own; a path per row
    files = items.select(F.col("l_suppkey").alias("project"), F.concat(F.lit("src/f"), row, F.lit(".ts")).alias("path"), F.floor("l_quantity").alias("size"))
    listed = items.where("l_suppkey % 3 = 0").select(F.col("l_suppkey").alias("project"), F.lit("README.md").alias("path"))
    return D.export_plan(files, listed, most_files=600, most_bytes=14_000)


@register(
    "generation_outcomes",
    "SELECT p_brand AS site, count(*) AS requested, count(*) FILTER (WHERE p_partkey % 4 = 0) AS succeeded, count(*) FILTER (WHERE p_partkey % 4 = 3) AS sloppy, count(*) FILTER (WHERE p_partkey % 4 > 0) > 0 AS partial FROM part GROUP BY 1",
)
def generation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses good, without JSON, for another component, and with code that is refused."""
    k = F.col("p_partkey")
    made = lambda who, code: F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.struct(who.alias("componentId"), F.lit("Card").alias("name"), F.lit("Card.tsx").alias("fileName"), F.lit(code).alias("code"))), F.lit("\n```"))
    clean = "const Card = () => { return (<div/>); };"
    said = F.when(k % 4 == 0, made(k.cast("string"), clean)).when(k % 4 == 1, F.lit("no")).when(k % 4 == 2, made(F.lit("other"), clean)).otherwise(made(k.cast("string"), "eval(x)"))
    rows = table(spark, sf_dir, "part").select("p_brand", k.alias("component_id"), said.alias("response"))
    out = D.generation_outcomes(rows, code_violations).join(rows.select("component_id", F.col("p_brand").alias("site")), "component_id")
    sloppy = out.groupBy("site").agg(F.count_if(F.col("outcome") == "SLOPPY_OUTPUT").alias("sloppy"))
    return D.generation_summary(out, "site").join(sloppy, "site").select("site", "requested", "succeeded", "sloppy", "partial")


@register("capped_pages", "SELECT o_custkey, count(*) - least(count(*), 5) AS n_dropped, least(count(*), 5) AS n_kept, min(o_orderkey) AS first FROM orders GROUP BY 1")
def capped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, dropped = D.page_cap(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], 5)
    return dropped.join(kept.groupBy("o_custkey").agg(F.count("*").alias("n_kept"), F.min("o_orderkey").alias("first")), "o_custkey")


@register("error_log", "SELECT event_id, 'UNKNOWN_ERROR' AS code, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'An unexpected error occurred.' END AS message FROM events WHERE event_type = 'error' OR event_id % 3 = 0")
def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries at WARN or above, as structured errors."""
    none = F.lit(None).cast("string")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_id") % 3 == 0, "WARN").when(F.col("event_id") % 3 == 1, "INFO").otherwise("TRACE")
    rows = table(spark, sf_dir, "events").where(D.at_level(level, "WARN"))
    made = D.structured_error(none, none, F.when(F.col("event_id") % 2 == 0, F.col("event_type")), none, F.lit(None).cast("boolean"))
    return rows.select("event_id", made.alias("e")).select("event_id", "e.code", "e.message")
