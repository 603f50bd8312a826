"""What a site is made with, from its detected technologies: buckets, analytics, build advice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.columns import let
from pagewright.functions.text import slugify

#: The bucket of each category; other categories have none.
BUCKETS = {
    "Frontend Framework": "frontend_framework",
    "Meta-Framework & SSR Engine": "frontend_framework",
    "Backend Framework & Server": "runtime",
    "Analytics & Tracking": "analytics",
    "CDN & Infrastructure": "cdn",
    "Hosting & PaaS": "cdn",
    "CSS Framework & Component UI": "ui_libraries",
    "JS Library & UI Utilities": "ui_libraries",
}
#: Buckets that hold one technology.
SINGLE = ("frontend_framework", "runtime", "cdn")
#: Identifiers of analytics containers.
CONTAINER = r"(G-[A-Z0-9]{4,}|GTM-[A-Z0-9]{4,}|UA-\d{4,}-\d+)"
#: Names that tell a package manager or a target, in the order in which they count.
MANAGERS = (("pnpm", "pnpm"), ("yarn", "yarn"), ("bun", "bun"))
TARGETS = (("cloudflare", "cloudflare_pages"), ("vercel", "vercel"), ("netlify", "netlify"), ("docker", "docker"))
DEFAULT_NODE = "20.x"


def bucket(category: Column) -> Column:
    return reduce(lambda c, kv: F.when(category == kv[0], kv[1]).otherwise(c), BUCKETS.items(), F.lit(None).cast("string"))


def surfaced(status: Column, score: Column) -> Column:
    return F.when(status.isNull(), score >= 0.5).otherwise(status.isin("detected", "probable"))


def shown_status(status: Column, score: Column) -> Column:
    """The status, or what the score says where an old row has none."""
    return F.coalesce(status, F.when(score >= 0.75, "detected").otherwise("probable"))


def container_id(evidence: Column) -> Column:
    """The first identifier in an array of evidence texts; null without one."""
    found = F.filter(F.transform(evidence, lambda e: F.regexp_extract(e, CONTAINER, 1)), lambda x: x != "")
    return F.get(found, F.lit(0))


def buckets(rows: DataFrame, by: str = "scan_id") -> DataFrame:
    """Per scan the technologies of each bucket, best first: (by, bucket, names), one name in a single bucket.

    Names are ordered by confidence, then name, then id; a scan has few of them.
    """
    known = rows.where(surfaced(F.col("confidence_status"), F.col("confidence"))).withColumn("bucket", bucket(F.col("category"))).where("bucket IS NOT NULL")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "name", F.col("technology_id").alias("id"))))
    lists = known.groupBy(by, "bucket").agg(ranked.alias("r"))
    kept = F.when(F.col("bucket").isin(*SINGLE), F.slice("r", 1, 1)).otherwise(F.col("r"))
    return lists.select(by, "bucket", F.transform(kept, lambda x: x["name"]).alias("names"))


def analytics(rows: DataFrame, by: str = "scan_id") -> DataFrame:
    """Distinct analytics providers per scan: (by, provider, container_id), of equal ones the most confident."""
    known = rows.where((F.col("category") == "Analytics & Tracking") & (F.coalesce("confidence_status", F.lit("")) != "unknown"))
    provider = F.coalesce("technology_id", slugify(F.col("name")))
    best = F.min_by(F.struct(container_id(F.col("evidence")).alias("container_id"), provider.alias("provider")), F.struct(-F.col("confidence"), F.col("name")))
    return known.groupBy(by, F.coalesce("technology_id", "name").alias("_key")).agg(best.alias("b")).select(by, "b.provider", "b.container_id")


def build_advice(rows: DataFrame, by: str = "scan_id") -> DataFrame:
    """Per scan (node_version, package_manager, target, build_command): advice from names, with defaults."""
    name = F.lower(F.concat_ws(" ", "name", "technology_id"))
    has = lambda text, word: F.bool_or(F.contains(text, F.lit(word)))
    node = (F.col("category") == "Backend Framework & Server") & F.lower("name").contains("node") & (F.coalesce("version", F.lit("")) != "")
    sums = rows.groupBy(by).agg(
        F.min_by(F.when(node, F.col("version")), F.when(node, F.col("technology_id"))).alias("node"),
        *[has(F.lower("name"), w).alias(f"m_{w}") for w, _ in MANAGERS],
        *[has(name, w).alias(f"t_{w}") for w, _ in TARGETS],
    )
    first = lambda rules, mark, other: F.coalesce(*[F.when(F.col(f"{mark}_{w}"), v) for w, v in rules], F.lit(other))
    major = let(F.regexp_extract("node", r"^(\d+)", 1), lambda m: F.when(m != "", F.concat(m, F.lit(".x"))))
    out = sums.select(by, F.coalesce(major, F.lit(DEFAULT_NODE)).alias("node_version"), first(MANAGERS, "m", "npm").alias("package_manager"), first(TARGETS, "t", "static_spa").alias("target"))
    return out.withColumn("build_command", F.concat("package_manager", F.lit(" run build")))
