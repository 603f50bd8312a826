"""Queries of synthesis: joins, aggregates, ranking and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import urls as U
from pagewright.operators import site as S
from pagewright.plans.registry import register
from pagewright.plans.session import table


@register("style_counts", "SELECT p_brand, p_type AS value, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS place FROM part GROUP BY 1, 2")
def style_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.value_counts(table(spark, sf_dir, "part").select("p_brand", F.col("p_type").alias("value")), ["p_brand"], "value")


@register("spacing_counts", "SELECT token, count(*) AS n FROM (SELECT unnest(string_split(p_name || ' ' || lower(p_type), ' ')) AS token FROM part) WHERE token <> '' GROUP BY 1")
def spacing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.explode(F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ")).alias("token"))
    return rows.where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


@register(
    "named_scale",
    """WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1), s AS (SELECT * FROM (VALUES (4, 'xs'), (8, 'sm'), (12, 'md'), (16, 'lg'), (24, 'xl')) v(size, name)),
j AS (SELECT p_size, n, name, CASE WHEN name IS NULL THEN row_number() OVER (PARTITION BY name IS NULL ORDER BY n DESC, p_size) END AS k FROM c LEFT JOIN s ON size = p_size)
SELECT p_size, n, coalesce(name, 'size' || k) AS token FROM j""",
)
def named_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with the names of a scale, others numbered by frequency."""
    counts = table(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("n"))
    scale = spark.createDataFrame([(4, "xs"), (8, "sm"), (12, "md"), (16, "lg"), (24, "xl")], "size int, name string")
    joined = counts.join(F.broadcast(scale), F.col("p_size") == F.col("size"), "left")
    k = F.row_number().over(Window.partitionBy(F.col("name").isNull()).orderBy(F.desc("n"), "p_size"))
    return joined.withColumn("k", k).select("p_size", "n", F.coalesce("name", F.concat(F.lit("size"), F.col("k").cast("string"))).alias("token"))


@register("font_families", "SELECT p_brand AS family, list_sort(list(DISTINCT p_size)) AS weights, list_sort(list(DISTINCT p_type)) AS styles FROM part GROUP BY 1")
def font_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("family")).agg(F.array_sort(F.collect_set("p_size")).alias("weights"), F.array_sort(F.collect_set("p_type")).alias("styles"))


@register("first_page_tokens", "SELECT l_partkey AS token, arg_min(l_extendedprice, l_orderkey * 10 + l_linenumber) AS value, count(*) AS n FROM lineitem GROUP BY 1")
def first_page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of the first page per key, and how many pages have it; of equal pages that which the table holds first.

    Page and place are one decimal, page before file before row, as Spark hashes
    fixed-width buffers and would sort all rows for a struct's.
    """
    at = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select(F.col("l_partkey").alias("token"), "l_extendedprice", at.alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    files = lines.select(F.col("_metadata.file_path").alias("file")).distinct().withColumn("rank", F.row_number().over(Window.orderBy("file")) - 1)  # a row for each file
    place = F.col("at").cast("decimal(38,0)") * F.lit(10**18).cast("decimal(19,0)") + (F.col("rank") * 10**12 + F.col("row"))
    order = F.when(F.col("l_extendedprice").isNotNull(), place.cast("decimal(38,0)"))
    return rows.join(F.broadcast(files), "file").groupBy("token").agg(F.min_by("l_extendedprice", order).alias("value"), F.count("*").alias("n"))


@register("default_layouts", "SELECT c_nationkey, arg_min(c_mktsegment, lpad((1000000 - n)::VARCHAR, 8, '0') || c_mktsegment) AS c_mktsegment, max(n) AS n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1")
def default_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.most_frequent(table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment"), ["c_nationkey"], "c_mktsegment")


@register("distinct_forms", "SELECT o_custkey, o_orderstatus, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2, 3")
def distinct_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row per method, action and name."""
    return S.first_wins(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderkey"), ["o_custkey", "o_orderstatus", "o_orderpriority"], ["o_orderkey"])


@register("unique_names", "SELECT p_partkey, p_name || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS unique_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.suffixed(table(spark, sf_dir, "part").select("p_partkey", "p_name"), [], "p_name", ["p_partkey"], "-").select("p_partkey", "unique_name")


@register("case_collisions", "SELECT lower(p_type) AS path, min(p_partkey) FILTER (WHERE n = 2) AS second FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY lower(p_type) ORDER BY p_partkey) AS n FROM part) GROUP BY 1 HAVING count(*) > 1")
def case_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(F.lower("p_type")).orderBy("p_partkey"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_type").alias("path"), n.alias("n"))
    return rows.where("n <= 2").groupBy("path").agg(F.max(F.when(F.col("n") == 2, F.col("p_partkey"))).alias("second")).where("second IS NOT NULL")


@register("running_ids", "SELECT event_id, 'evt_' || event_type || '_' || row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS id FROM events")
def running_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.numbered(table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_type"], ["event_id"], "n")
    return rows.select("event_id", F.concat_ws("_", F.lit("evt"), "event_type", F.col("n").cast("string")).alias("id"))


@register("last_logs", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")
def last_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five rows per key."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", n.alias("n")).where("n <= 5").drop("n")


@register("scan_progress", "SELECT user_id, event_id, least(100, CAST(round(100.0 * count(*) FILTER (WHERE event_type = 'view') OVER (PARTITION BY user_id ORDER BY event_id) / 50) AS BIGINT)) AS percent FROM events")
def scan_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    upto = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    done = F.count_if(F.col("event_type") == "view").over(upto)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.least(F.lit(100), F.round(done * 100.0 / 50).cast("bigint")).alias("percent"))


_MENU = "least(event_id % 4, 2)"


@register(
    "menu_parents",
    f"""WITH r AS (SELECT user_id, event_id, {_MENU} AS depth FROM events)
SELECT a.user_id, a.event_id, max(b.event_id) AS parent_seq FROM r a LEFT JOIN r b ON a.user_id = b.user_id AND b.event_id < a.event_id AND b.depth < a.depth GROUP BY 1, 2""",
)
def menu_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parent of each menu item: the last before it that lies higher."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.expr(_MENU).alias("depth"))
    found = S.parents_by_depth(rows, ["user_id"], "seq", "depth", 3)
    return found.select("user_id", F.col("seq").alias("event_id"), "parent_seq")


@register(
    "dynamic_routes",
    """WITH p AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS s FROM pages),
e AS (SELECT host, s, len(s) AS depth, unnest(range(0, len(s))) AS position FROM p),
k AS (SELECT host, depth, position, s[position + 1] AS v, array_to_string(s[:position] || ['*'] || s[position + 2:], '/') AS rest FROM e),
g AS (SELECT host, depth, position, rest, count(*) AS n_paths, bool_and(regexp_matches(v, '^[0-9]+$')) AS digits FROM k GROUP BY ALL HAVING count(DISTINCT v) >= 2)
SELECT host, depth, position, '/' || array_to_string(list_transform(string_split(rest, '/'), lambda x: CASE WHEN x = '*' THEN ':' || CASE WHEN position = depth - 1 THEN CASE WHEN digits THEN 'id' ELSE 'slug' END ELSE 'param' || (position + 1) END ELSE x END), '/') AS pattern, n_paths FROM g""",
)
def dynamic_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of a host that differ in one segment."""
    rows = table(spark, sf_dir, "pages").select(U.url_parts(F.col("url"))["host"].alias("host"), U.url_parts(F.col("url"))["path"].alias("path"))
    return S.single_position_patterns(rows, "host", "path").drop("rest")


@register("dynamic_routes_greedy")
def dynamic_routes_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, each path used once; the tests hold it against a sequential version."""
    rows = table(spark, sf_dir, "pages").select(U.url_parts(F.col("url"))["host"].alias("host"), U.url_parts(F.col("url"))["path"].alias("path"))
    return S.greedy_patterns(rows, "host", "path")


@register("guarded_routes", "SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment) FILTER (WHERE c_acctbal < 0)) AS guarded, bool_or(c_acctbal < 0) AS any_guarded FROM customer GROUP BY 1")
def guarded_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.col("c_acctbal") < 0
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set(F.when(bad, F.col("c_mktsegment")))).alias("guarded"), F.bool_or(bad).alias("any_guarded"))
    return rows.withColumn("guarded", F.when(F.size("guarded") > 0, F.col("guarded")))


@register("breakpoint_names", "SELECT p_size AS px, coalesce(['sm', 'md', 'lg', 'xl', '2xl', '3xl'][row_number() OVER (ORDER BY p_size)], 'bp_' || row_number() OVER (ORDER BY p_size)) AS name FROM (SELECT DISTINCT p_size FROM part)")
def breakpoint_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct widths in order, named.  They are few, whatever the number of pages."""
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("px")).distinct().withColumn("n", F.row_number().over(Window.orderBy("px")))
    names = F.array(*map(F.lit, ("sm", "md", "lg", "xl", "2xl", "3xl")))
    return rows.select("px", F.coalesce(F.get(names, F.col("n") - 1), F.concat(F.lit("bp_"), F.col("n").cast("string"))).alias("name"))


@register("crawl_counters", "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS scanned, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'signup') AS auth_required, min(value) FILTER (WHERE value > 50) AS expiry FROM events GROUP BY 1")
def crawl_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda k: F.count_if(F.col("event_type") == k)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(of("view").alias("scanned"), of("error").alias("failed"), of("signup").alias("auth_required"), F.min(F.when(F.col("value") > 50, F.col("value"))).alias("expiry"))


@register("export_limits", "SELECT l_suppkey, CASE WHEN count(*) > 650 THEN 'too_many_files' WHEN max(l_extendedprice) > 104900 THEN 'file_too_large' WHEN sum(l_extendedprice) > 33000000 THEN 'too_large' END AS violation FROM lineitem GROUP BY 1")
def export_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first limit that an export breaks."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.max("l_extendedprice").alias("largest"), F.sum("l_extendedprice").alias("total"))
    return sums.select("l_suppkey", F.when(F.col("n") > 650, "too_many_files").when(F.col("largest") > 104900, "file_too_large").when(F.col("total") > 33000000, "too_large").alias("violation"))


@register("directory_tree", "SELECT prefix, count(*) AS n_files FROM (SELECT DISTINCT unnest(list_transform(range(1, len(s) + 1), lambda i: array_to_string(s[:i], '/'))) AS prefix, file FROM (SELECT p_partkey AS file, [p_brand, p_type, p_name] AS s FROM part)) GROUP BY 1")
def directory_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every directory of a set of paths, with the files below it."""
    parts = F.array("p_brand", "p_type", "p_name")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return table(spark, sf_dir, "part").select(F.explode(prefixes).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n_files"))


@register("diff_summary", "SELECT l_shipdate::DATE AS day, count(*) FILTER (WHERE l_linestatus = 'F') AS compared, count(*) FILTER (WHERE l_linestatus <> 'F') AS skipped, round(avg(round(l_discount * 1000, 2)) FILTER (WHERE l_linestatus = 'F'), 2) AS similarity, bool_or(l_linestatus <> 'F') AS partial FROM lineitem GROUP BY 1")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities rounded before and after their mean."""
    done = F.col("l_linestatus") == "F"
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(
        F.count_if(done).alias("compared"), F.count_if(~done).alias("skipped"), F.round(F.avg(F.when(done, F.round(F.col("l_discount") * 1000, 2))), 2).alias("similarity"), F.bool_or(~done).alias("partial")
    )


@register("join_kinds", """SELECT count(*) FILTER (WHERE o.o_orderkey IS NOT NULL) AS inner_rows, count(*) FILTER (WHERE o.o_orderkey IS NULL) AS left_only,
(SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS semi_rows, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS anti_rows,
(SELECT count(*) FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id) AS full_rows FROM customer LEFT JOIN orders o ON c_custkey = o_custkey""")
def join_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of the lookups that sites are put together with."""
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    on = F.col("c_custkey") == F.col("o_custkey")
    left = c.join(o, on, "left").agg(F.count("o_orderkey").alias("inner_rows"), F.count_if(F.col("o_orderkey").isNull()).alias("left_only"))
    semi, anti = (c.join(o, on, how).agg(F.count("*").alias(f"{k}_rows")) for how, k in (("left_semi", "semi"), ("left_anti", "anti")))
    full = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "full").agg(F.count("*").alias("full_rows"))
    return left.crossJoin(semi).crossJoin(anti).crossJoin(full)  # one row each


@register("route_files", """WITH r AS (SELECT o_orderkey AS route, o_custkey % 1600 AS page, o_orderdate AS path, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS n FROM orders)
SELECT route, CASE WHEN route % 97 = 0 THEN 'invalid_path' WHEN c_custkey IS NULL THEN 'missing_page' WHEN n > 1 THEN 'duplicate_path' ELSE 'kept' END AS outcome FROM r LEFT JOIN customer ON c_custkey = page""")
def route_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes with their pages, and why some are dropped."""
    n = F.row_number().over(Window.partitionBy("o_orderdate").orderBy("o_orderkey"))
    routes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("route"), (F.col("o_custkey") % 1600).alias("page"), n.alias("n"))
    joined = routes.join(table(spark, sf_dir, "customer").select("c_custkey"), F.col("page") == F.col("c_custkey"), "left")
    outcome = F.when(F.col("route") % 97 == 0, "invalid_path").when(F.col("c_custkey").isNull(), "missing_page").when(F.col("n") > 1, "duplicate_path").otherwise("kept")
    return joined.select("route", outcome.alias("outcome"))


@register("dangling_children", "SELECT l_orderkey AS parent, l_partkey AS child FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def dangling_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "part").where("p_size <= 25").select("p_partkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_partkey").alias("child"))
    return rows.join(known, F.col("child") == F.col("p_partkey"), "left_anti")


@register("child_names", "SELECT l_orderkey, list_sort(list(DISTINCT p_name)) AS names FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def child_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_name")).alias("names"))


@register("profile_captures", "SELECT n_nationkey, r_regionkey, count(c_custkey) AS captured, count(c_custkey) = 0 AS skipped FROM nation CROSS JOIN region LEFT JOIN customer ON c_nationkey = n_nationkey AND c_custkey % 5 = r_regionkey GROUP BY 1, 2")
def profile_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page in every profile: profiles are five, so the product is bounded by the pages."""
    pairs = table(spark, sf_dir, "nation").select("n_nationkey").crossJoin(F.broadcast(table(spark, sf_dir, "region").select("r_regionkey")))
    shots = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey"), (F.col("c_custkey") % 5).cast("int").alias("r_regionkey")).agg(F.count("*").alias("n"))
    joined = pairs.join(shots, ["n_nationkey", "r_regionkey"], "left")
    return joined.select("n_nationkey", "r_regionkey", F.coalesce("n", F.lit(0)).alias("captured"), F.col("n").isNull().alias("skipped"))


@register("set_operations", "SELECT c_nationkey AS k, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier UNION SELECT * FROM (SELECT c_nationkey, 'customers' FROM customer EXCEPT SELECT s_nationkey, 'customers' FROM supplier)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("side", F.lit("both")).unionByName(c.subtract(s).withColumn("side", F.lit("customers")))


@register("class_variants", "WITH i AS (SELECT p_brand, list_distinct(string_split(p_name, ' ') || [p_type]) AS cs FROM part), n AS (SELECT p_brand, count(*) AS n_instances FROM i GROUP BY 1), c AS (SELECT p_brand, c, count(*) AS k FROM (SELECT p_brand, unnest(cs) AS c FROM i) GROUP BY 1, 2) SELECT n.p_brand, n_instances, coalesce(string_agg(c, ',' ORDER BY c), '') AS shared FROM n LEFT JOIN c ON c.p_brand = n.p_brand AND k = n_instances GROUP BY 1, 2")
def class_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", F.concat(F.split("p_name", " "), F.array("p_type")).alias("classes"))
    return S.variants(rows, "p_brand", "classes").withColumn("shared", F.array_join("shared", ","))


@register("component_depth", """WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey % 25 AS parent, (c_nationkey * 3 + 1) % 25 AS child FROM customer), d(node, depth) AS (SELECT 0, 0 UNION SELECT child, depth + 1 FROM d JOIN e ON parent = node WHERE depth < 12)
SELECT node, min(depth) AS depth FROM d GROUP BY 1""")
def component_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of each component below the root, in twelve steps at most; cycles end by themselves."""
    edges = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 25).alias("parent"), ((F.col("c_nationkey") * 3 + 1) % 25).alias("child")).distinct()
    return S.depth_from_roots(edges, "parent", "child", spark.range(1).select(F.col("id").cast("int").alias("id")), "id", 12)


@register("planned_docs", "SELECT n_name AS doc FROM nation WHERE (n_regionkey = 0 OR n_nationkey % 2 = 0) AND n_nationkey % 5 <> 4")
def planned_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required documents and those opted into, without those left out."""
    nation = table(spark, sf_dir, "nation")
    wanted = nation.where("n_regionkey = 0").select("n_name").union(nation.where("n_nationkey % 2 = 0").select("n_name")).distinct()
    return wanted.join(nation.where("n_nationkey % 5 = 4").select("n_name"), "n_name", "left_anti").select(F.col("n_name").alias("doc"))


@register(
    "site_documents",
    """SELECT *, '{"host":"' || host || '","pages":' || n_pages || ',"first":' || first_page || '}' AS document FROM (
SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, count(*) AS n_pages, min(page_id) AS first_page, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages GROUP BY 1)""",
)
def site_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per site from aggregates of its pages."""
    rows = table(spark, sf_dir, "pages").groupBy(U.url_parts(F.col("url"))["host"].alias("host")).agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"), F.sum(F.octet_length("html")).alias("bytes"))
    return rows.withColumn("document", F.to_json(F.struct("host", F.col("n_pages").alias("pages"), F.col("first_page").alias("first"))))
