"""Queries on keyed tables.  Orders stand for scans, customers for projects, line items for assets, events for changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.operators import store as S
from pagewright.plans.registry import register
from pagewright.plans.session import table


@register("list_projects", "SELECT c_custkey, c_name, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_name DESC, c_custkey DESC) AS place FROM customer WHERE c_mktsegment = 'BUILDING' QUALIFY place <= 500")
def list_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list in the order of two keys and the row's own, cut at what a screen shows."""
    rows = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name", "c_acctbal")
    top = rows.orderBy(F.desc("c_acctbal"), F.desc("c_name"), F.desc("c_custkey")).limit(500)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("c_acctbal"), F.desc("c_name"), F.desc("c_custkey"))))


@register("active_scans", "SELECT o_custkey, count(*) AS n_active, min(o_orderdate) AS first_started, arg_min(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS first_scan FROM orders WHERE o_orderstatus IN ('P', 'O') GROUP BY o_custkey")
def active_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("P", "O"))
    return rows.groupBy("o_custkey").agg(F.count("*").alias("n_active"), F.min("o_orderdate").alias("first_started"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_scan"))


@register("scan_counts", "SELECT l_orderkey AS scan_id, count(*) AS pages, count(*) FILTER (WHERE l_linestatus <> 'F') AS failed, count(DISTINCT l_partkey) AS assets FROM lineitem GROUP BY 1")
def scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("scan_id")).agg(F.count("*").alias("pages"), F.count_if(F.col("l_linestatus") != "F").alias("failed"), F.count_distinct("l_partkey").alias("assets"))


@register("latest_by_group", "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row per group, without a sort of the groups."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return S.newest(rows, ["o_custkey"], F.struct("o_orderdate", "o_orderkey"))


@register("next_version", "SELECT c_custkey, coalesce(max(o_orderkey), 0) + 1 AS next_version FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("top"))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(top, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", (F.coalesce("top", F.lit(0)) + 1).alias("next_version"))


@register("search_pages", "SELECT doc_id, source, count(*) OVER () AS n_found, greatest(count(*) OVER () - 500, 0) AS n_hidden FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license') ORDER BY doc_id LIMIT 500")
def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that contain a text, whatever its case; the first 500 and the number of the rest."""
    hit = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("license")) | F.contains(F.lower("source"), F.lit("license"))).select("doc_id", "source")
    total = hit.agg(F.count("*").alias("n_found"))
    return hit.orderBy("doc_id").limit(500).join(F.broadcast(total)).withColumn("n_hidden", F.greatest(F.col("n_found") - 500, F.lit(0)))


@register("settings_pairs", "SELECT 'user/' || user_id AS key, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def settings_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key-value table after all writes."""
    writes = table(spark, sf_dir, "events").select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("key"), "value", F.col("event_id").alias("seq"))
    return S.upsert(writes.limit(0), writes, ["key"]).select("key", "value")


@register(
    "upsert_pages",
    """WITH r AS (SELECT user_id AS scan_id, event_type AS url, event_id AS seq, value AS load_ms, CASE WHEN event_id % 3 = 0 THEN 'raw/' || event_id END AS raw_path FROM events)
SELECT scan_id, url, max(seq) AS seq, arg_max(load_ms, seq) AS load_ms, arg_max(raw_path, seq) FILTER (WHERE raw_path IS NOT NULL) AS raw_path FROM r GROUP BY scan_id, url""",
)
def upsert_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by (scan, url): the last row, but a path that a later row lacks stays."""
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("raw/"), F.col("event_id").cast("string")))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("scan_id"), F.col("event_type").alias("url"), F.col("event_id").alias("seq"), F.col("value").alias("load_ms"), raw.alias("raw_path"))
    return S.upsert(rows.limit(0), rows, ["scan_id", "url"], ["raw_path"])


@register(
    "upsert_technologies",
    """WITH r AS (SELECT o_custkey AS scan_id, CASE WHEN o_orderkey % 10 > 0 THEN o_orderpriority END AS technology_id, o_orderkey AS seq, o_totalprice AS confidence FROM orders)
SELECT scan_id, technology_id, seq, confidence FROM r WHERE technology_id IS NULL UNION ALL SELECT scan_id, technology_id, max(seq), arg_max(confidence, seq) FROM r WHERE technology_id IS NOT NULL GROUP BY 1, 2""",
)
def upsert_technologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technologies by (scan, technology): the last row; rows without a technology never meet."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scan_id"), F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderpriority")).alias("technology_id"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("confidence"))
    return S.upsert(rows.limit(0), rows, ["scan_id", "technology_id"])


@register(
    "upsert_assets",
    """WITH r AS (SELECT l_suppkey AS scan_id, l_partkey % 50 AS sha, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_quantity > 20 THEN l_orderkey END AS page_id, l_extendedprice AS size FROM lineitem),
d AS (SELECT scan_id, sha, max(struct_pack(s := seq, z := size, p := page_id)) AS l, min(struct_pack(s := seq, p := page_id)) FILTER (WHERE page_id IS NOT NULL) AS f FROM r GROUP BY 1, 2)
SELECT scan_id, sha, l.s AS seq, f.p AS page_id FROM d""",
)
def upsert_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets by (scan, hash): the last row, with the first page that is known."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("scan_id"), (F.col("l_partkey") % 50).alias("sha"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_quantity") > 20, F.col("l_orderkey")).alias("page_id"), F.col("l_extendedprice").alias("size")
    )
    return S.upsert(rows.limit(0), rows, ["scan_id", "sha"], keep_first=["page_id"]).select("scan_id", "sha", "seq", "page_id")


@register("patch_projects", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'renamed ' || c_name ELSE c_name END AS c_name, c_acctbal FROM customer")
def patch_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial updates: only the fields that a change has."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    changes = rows.where("c_custkey % 3 = 0").select("c_custkey", F.concat(F.lit("renamed "), "c_name").alias("c_name"), F.lit(None).cast("double").alias("c_acctbal"))
    return S.patch(rows, changes, "c_custkey")


@register("delete_cascade", "SELECT 'orders' AS kind, count(*) AS n FROM orders WHERE o_custkey % 5 > 0 UNION ALL SELECT 'projects', count(*) FROM customer WHERE c_custkey % 5 > 0 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 5 = 0)")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects deleted with their scans, and these with their pages."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    projects, (scans,) = S.delete_cascade(table(spark, sf_dir, "customer"), [(orders, "o_custkey")], "c_custkey", F.expr("c_custkey % 5 = 0"))
    _, (pages,) = S.delete_cascade(orders, [(items, "l_orderkey")], "o_orderkey", F.expr("o_custkey % 5 = 0"))
    count = lambda d, k: d.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return count(projects, "projects").unionByName(count(scans, "orders")).unionByName(count(pages, "lineitem"))


@register("active_session", "SELECT user_id AS project_id, max(event_id) AS session_id, count(*) - 1 AS n_retired FROM events WHERE event_type = 'signup' GROUP BY user_id")
def active_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each new session of a project retires the one before: one stays active."""
    rows = table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("session_id"))
    counts = rows.groupBy("project_id").agg((F.count("*") - 1).alias("n_retired"))
    return S.newest(rows, ["project_id"], F.col("session_id")).join(counts, "project_id")


@register("purge_expired", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def purge_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have not expired; text in either form of a timestamp is parsed before it is compared."""
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    when = F.try_to_timestamp(text)
    return table(spark, sf_dir, "events").where(when > F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id")


@register(
    "constraint_report",
    """SELECT 'unique' AS rule, count(*) AS n FROM (SELECT o_custkey, o_orderdate FROM orders GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'reference', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'enumeration', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'range', count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 0.05""",
)
def constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows break each constraint."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    found = {
        "unique": S.violations_unique(orders, ["o_custkey", "o_orderdate"]),
        "reference": S.violations_reference(items, orders, "l_orderkey", "o_orderkey"),
        "enumeration": orders.where(~F.col("o_orderstatus").isin("F", "O")),
        "range": items.where(~F.col("l_discount").between(0, 0.05)),
    }
    parts = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("rule"), "n") for k, d in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_STATES = "['pending', 'in_progress', 'completed', 'failed', 'cancelled'][event_id % 5 + 1]"


@register(
    "transition_errors",
    f"""WITH s AS (SELECT user_id, event_id, {_STATES} AS state, lag({_STATES}) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events)
SELECT user_id, event_id, prev AS before, state FROM s WHERE prev IS NOT NULL AND prev <> state AND NOT (prev = 'pending' AND state IN ('in_progress', 'cancelled', 'failed')) AND NOT (prev = 'in_progress' AND state IN ('completed', 'failed', 'cancelled'))""",
)
def transition_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of state that the state machine of scans forbids."""
    state = F.element_at(F.array(*map(F.lit, ("pending", "in_progress", "completed", "failed", "cancelled"))), (F.col("event_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", state.alias("state"))
    return S.transition_errors(rows, "user_id", "event_id", "state").select("user_id", "event_id", "before", "state")


@register("terminal_stamps", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'P') THEN o_orderdate END AS completed_at, greatest(CAST(floor(o_totalprice / 1000) AS BIGINT) - 50, 0) AS scanned FROM orders")
def terminal_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A terminal state stamps its time, others clear it; counters never fall below zero."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus").isin("F", "P"), F.col("o_orderdate")).alias("completed_at"), F.greatest(F.floor(F.col("o_totalprice") / 1000) - 50, F.lit(0)).alias("scanned"))


@register("pending_migrations", "SELECT n_nationkey AS version, md5(n_name) AS checksum, CASE WHEN n_nationkey > 15 THEN 'pending' WHEN n_nationkey % 7 = 0 THEN 'mismatch' ELSE 'applied' END AS state FROM nation")
def pending_migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("version"), F.md5("n_name").alias("checksum"))
    applied = known.where("version <= 15").withColumn("checksum", F.when(F.col("version") % 7 == 0, "other").otherwise(F.col("checksum")))
    return S.pending_migrations(known, applied)
