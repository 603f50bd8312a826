"""Queries on the parts of a site's document: routes, components, styles, assets, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import html as H
from pagewright.functions import urls as U
from pagewright.operators import blueprint as B
from pagewright.plans.registry import register
from pagewright.plans.session import table

_SITES = r"""p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS site, CASE WHEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '://[^/?#]*([^?#]*)', 1) END AS path, html, CASE WHEN contains(html, '<form') THEN 'auth_required' ELSE 'public' END AS auth_status FROM pages)"""
_ROWS = (
    _SITES
    + r""", s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS s, left(regexp_replace(regexp_replace(lower(path), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 64) AS slug FROM p),
g AS (SELECT site, len(s) AS depth, array_to_string(s[:len(s) - 1], '/') AS pre, bool_and(regexp_matches(s[len(s)], '^[0-9]+$')) AS digits FROM s WHERE len(s) > 0 GROUP BY ALL HAVING count(DISTINCT s[len(s)]) >= 2),
r AS (SELECT s.site, page_id, path, auth_status = 'auth_required' AS auth_required, g.site IS NOT NULL AS is_dynamic, row_number() OVER (PARTITION BY s.site ORDER BY path, page_id) AS place,
  CASE WHEN path = '/' THEN 'page_home' ELSE 'page_' || CASE WHEN slug = '' THEN 'root' ELSE slug END END AS base,
  CASE WHEN g.site IS NULL THEN path ELSE '/' || CASE WHEN pre = '' THEN '' ELSE pre || '/' END || CASE WHEN digits THEN ':id' ELSE ':slug' END END AS route
  FROM s LEFT JOIN g ON g.site = s.site AND g.depth = len(s) AND g.pre = array_to_string(s[:len(s) - 1], '/')),
rows_ AS (SELECT *, base || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS id FROM (SELECT *, row_number() OVER (PARTITION BY site, base ORDER BY path, page_id) AS k FROM r WHERE place <= 500)),
routes AS (SELECT site, route, id, is_dynamic, auth_required, row_number() OVER (PARTITION BY site ORDER BY place) AS place FROM (SELECT *, row_number() OVER (PARTITION BY site, route ORDER BY place) AS first FROM rows_) WHERE first = 1)"""
)


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as (site, page_id, path, title, description, auth_status, html); a page with a form is a guarded one."""
    parts, html = U.url_parts(F.col("url")), F.col("html")
    path = F.when(parts["path"] == "", "/").otherwise(parts["path"])
    guarded = F.when(F.contains(html, F.lit("<form")), "auth_required").otherwise("public")
    return table(spark, sf_dir, "pages").select(parts["host"].alias("site"), "page_id", path.alias("path"), H.title(html).alias("title"), H.meta_tags(html)["description"].alias("description"), guarded.alias("auth_status"), "html")


def _page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = site_pages(spark, sf_dir).select("site", "page_id", "path", "auth_status")
    return B.page_rows(pages, B.path_patterns(pages))


@register("site_page_rows", "WITH " + _ROWS + " SELECT site, page_id, id, route, is_dynamic, auth_required FROM rows_")
def site_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_rows(spark, sf_dir).select("site", "page_id", "id", "route", "is_dynamic", "auth_required")


@register("site_routes", "WITH " + _ROWS + " SELECT * FROM routes WHERE place <= 500")
def site_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.routes(_page_rows(spark, sf_dir))


@register(
    "site_authentication",
    "WITH " + _SITES + r""" SELECT site, CASE WHEN count(*) FILTER (WHERE auth_status = 'auth_required') > 0 THEN 'cookie_session' ELSE 'none' END AS type, coalesce(string_agg(DISTINCT path, ',' ORDER BY path) FILTER (WHERE auth_status = 'auth_required'), '') AS protected,
min(path) FILTER (WHERE auth_status = 'auth_required' AND regexp_matches(path, '(?i)/(dashboard|admin|account|app)(/|$)')) AS dashboard_route FROM p GROUP BY 1""",
)
def site_authentication(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.authentication(site_pages(spark, sf_dir)).select("site", "type", F.array_join("protected", ",").alias("protected"), "dashboard_route")


@register(
    "site_documents_json",
    "WITH " + _ROWS + """, j AS (SELECT site, string_agg('{"route":"' || route || '","id":"' || id || '","is_dynamic":' || is_dynamic || ',"auth_required":' || auth_required || '}', ',' ORDER BY place) AS t FROM routes WHERE place <= 500 GROUP BY 1),
a AS (SELECT site, count(*) FILTER (WHERE auth_required) > 0 AS any_ FROM r GROUP BY 1)
SELECT site, '{"site":"' || site || '","routes":[' || t || '],"authentication":[{"type":"' || CASE WHEN any_ THEN 'cookie_session' ELSE 'none' END || '"}]}' AS document FROM j JOIN a USING (site)""",
)
def site_documents_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes and sign-in of each site as one document."""
    rows = _page_rows(spark, sf_dir)
    sections = {"routes": B.routes(rows), "authentication": B.authentication(site_pages(spark, sf_dir)).select("site", "type")}
    return B.assembled(rows.select("site"), sections)


@register(
    "site_sections",
    "WITH " + _SITES + r""", t AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS title FROM p QUALIFY row_number() OVER (PARTITION BY site ORDER BY path <> '/', path, page_id) = 1),
n AS (SELECT *, regexp_replace(regexp_replace(site, ':\d+$', ''), '^www\.', '') AS name, trim(regexp_extract(title, '^.+?\s*[|\-–—]\s*(.+)$', 1)) AS suffix FROM t)
SELECT site, name, CASE WHEN title = '' THEN '' WHEN suffix <> '' THEN '%s | ' || suffix WHEN name <> '' THEN '%s | ' || name ELSE '' END AS title_template FROM n""",
)
def site_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.site_sections(site_pages(spark, sf_dir)).select("site", "name", "title_template")


_COMPONENTS = """c AS (SELECT 'o' || o_orderkey AS id, o_orderpriority AS name, o_orderstatus AS site FROM orders UNION ALL SELECT 'p' || p_partkey, p_type, 'O' FROM part WHERE p_size <= 40),
k AS (SELECT id, child, row_number() OVER (PARTITION BY id ORDER BY line, child) AS place FROM (SELECT DISTINCT 'o' || l_orderkey AS id, l_linenumber AS line, 'p' || l_partkey AS child FROM lineitem))"""


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as components whose children are their parts, and smaller parts as components without children."""
    items = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("component_id"), F.struct("l_linenumber", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("child")).alias("c"))
    lists = items.distinct().groupBy("component_id").agg(F.transform(F.array_sort(F.collect_list("c")), lambda x: x["child"]).alias("children"))
    none = F.array().cast("array<string>")
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("component_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("site"))
    parts = table(spark, sf_dir, "part").where("p_size <= 40").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("component_id"), F.col("p_type").alias("name"), F.lit("O").alias("site"), none.alias("children"))
    return orders.join(lists, "component_id", "left").select("component_id", "name", "site", F.coalesce("children", none).alias("children")).unionByName(parts)


@register(
    "component_payloads",
    "WITH " + _COMPONENTS + """, named AS (SELECT k.id, c.name, min(place) AS place FROM k JOIN c ON c.id = k.child GROUP BY 1, 2),
n AS (SELECT id, string_agg(name, ',' ORDER BY place, name) AS names FROM named GROUP BY 1),
o AS (SELECT 'o' || l_orderkey AS id, string_agg(l_linestatus || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS overrides FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r <= 20 GROUP BY 1)
SELECT c.id AS component_id, coalesce(names, '') AS names, coalesce(overrides, '') AS overrides, CASE WHEN starts_with(c.id, 'p') THEN '<b>' || c.name || '</b>' END AS markup FROM c LEFT JOIN n USING (id) LEFT JOIN o USING (id)""",
)
def component_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each component with its children's names, its overrides and its markup."""
    components = _components(spark, sf_dir)
    items = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("component_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq"), F.col("l_linestatus").alias("breakpoint"), F.col("l_returnflag").alias("action"))
    fragments = components.where("component_id LIKE 'p%'").select("component_id", F.concat(F.lit("<b>"), "name", F.lit("</b>")).alias("markup"))
    made = B.component_payloads(components, items, items.select("component_id", "seq", F.col("breakpoint").alias("event"), "action").limit(0), fragments)
    shown = F.array_join(F.transform(F.coalesce("overrides", F.array()), lambda x: F.concat_ws(":", x["breakpoint"], x["action"])), ",")
    return made.select("component_id", F.array_join(F.coalesce("names", F.array()), ",").alias("names"), shown.alias("overrides"), "markup")


@register("dangling_component_children", "WITH " + _COMPONENTS + " SELECT DISTINCT c.site, c.id AS component_id, k.child FROM c JOIN k USING (id) WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.site = c.site AND d.id = k.child)")
def dangling_component_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children that are in no component of the site."""
    return B.dangling_children(_components(spark, sf_dir))


@register(
    "page_component_files",
    "WITH " + _COMPONENTS + """ SELECT k.id AS page_id, (row_number() OVER (PARTITION BY k.id ORDER BY place, child)) AS n, child AS component_id, p_name || '.tsx' AS file, 'size={' || p_size || '}' AS attrs FROM k JOIN part ON child = 'p' || p_partkey WHERE p_size <= 25""",
)
def page_component_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each order's parts, and the props that these need."""
    pages = _components(spark, sf_dir).where("size(children) > 0").select(F.col("component_id").alias("page_id"), F.col("children").alias("root_component_ids"))
    key = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    parts = table(spark, sf_dir, "part").where("p_size <= 25")
    props = F.array(F.struct(F.lit("size").alias("name"), F.lit(True).alias("required"), F.col("p_size").cast("string").alias("literal")), F.struct(F.lit("brand").alias("name"), F.lit(False).alias("required"), F.col("p_brand").alias("literal")))
    files = parts.select(key.alias("component_id"), F.concat("p_name", F.lit(".tsx")).alias("file"))
    found = B.page_components(pages, files).join(B.required_props(files, parts.select(key.alias("component_id"), props.alias("props"))), "component_id")
    return B.first_of(found.withColumnRenamed("place", "at"), ["page_id"], ["at", "component_id"], 1_000).select("page_id", F.col("place").alias("n"), "component_id", "file", "attrs")


@register("analysed_pages", "SELECT o_orderkey AS page_id, n_items, c_mktsegment AS layout_id FROM orders JOIN (SELECT l_orderkey, count(*) AS n_items FROM lineitem WHERE l_quantity > 25 GROUP BY 1) ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0")
def analysed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages, their larger items as evidence, their customers as segmentation."""
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), "o_custkey")
    evidence = table(spark, sf_dir, "lineitem").where("l_quantity > 25").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.count("*").alias("n_items"))
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("layout_id"))
    segmentation = pages.join(customers, "o_custkey").select("page_id", "layout_id")
    return B.pages_with_evidence(pages.select("page_id"), evidence, segmentation)


_STYLES = """st AS (SELECT l_returnflag AS site, l_orderkey AS page_id, l_linenumber || 'px auto ' || (l_suppkey % 9) || 'px' AS margin, (l_suppkey % 9) || 'px ' || (l_suppkey % 9) || 'px' AS padding, CASE WHEN l_linenumber > 3 THEN '1rem' ELSE '0' END AS gap FROM lineitem)"""


def _styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as nodes with spacing made of their numbers."""
    n, k = F.col("l_linenumber").cast("string"), (F.col("l_suppkey") % 9).cast("string")
    items = table(spark, sf_dir, "lineitem")
    return items.select(F.col("l_returnflag").alias("site"), F.col("l_orderkey").alias("page_id"), F.concat(n, F.lit("px auto "), k, F.lit("px")).alias("margin"), F.concat(k, F.lit("px "), k, F.lit("px")).alias("padding"), F.when(F.col("l_linenumber") > 3, "1rem").otherwise("0").alias("gap"))


@register(
    "site_spacing",
    "WITH " + _STYLES + """, v AS (SELECT site, unnest(list_distinct(string_split(margin, ' ')) || list_distinct(string_split(padding, ' ')) || [gap]) AS value FROM st),
n AS (SELECT site, value, count(*) AS n FROM v WHERE value NOT IN ('', '0px', 'auto', 'normal', '0', '0rem') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, value) AS place FROM n),
m AS (SELECT *, CASE value WHEN '1rem' THEN '4' WHEN '3px' THEN 'thin' WHEN '4px' THEN 'thin' END AS name FROM r WHERE place <= 100),
a AS (SELECT *, name IS NOT NULL AND row_number() OVER (PARTITION BY site, name ORDER BY place) > 1 AS again FROM m),
c AS (SELECT *, count(*) FILTER (WHERE name IS NULL OR again) OVER (PARTITION BY site ORDER BY place) AS k FROM a)
SELECT site, CASE WHEN name IS NULL THEN 'space_' || k WHEN again THEN name || '_' || k ELSE name END AS key, value, CAST(n AS BIGINT) AS n FROM c""",
)
def site_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spacing of a site, counted per page and added up, with keys."""
    merged = B.merged_counts(B.spacing_counts(_styles(spark, sf_dir)))
    return B.keyed(merged, {"1rem": "4", "3px": "thin", "4px": "thin"}, "space")


_SIZES = ("0.75rem", "1rem", "18px", "1.125rem", "22px", "3rem", "normal", "1rem")


@register(
    "site_font_sizes",
    f"""WITH v AS (SELECT p_brand AS site, {list(_SIZES)!r}[p_size % 8 + 1] AS value FROM part), n AS (SELECT site, value, count(*) AS n FROM v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, value) AS place FROM n),
m AS (SELECT *, CASE value WHEN '0.75rem' THEN 'xs' WHEN '1rem' THEN 'base' WHEN '1.125rem' THEN 'lg' WHEN '3rem' THEN '5xl' END AS name FROM r)
SELECT site, coalesce(name, 'size_' || count(*) FILTER (WHERE name IS NULL) OVER (PARTITION BY site ORDER BY place)) AS key, value, n FROM m""",
)
def site_font_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.element_at(F.array(*map(F.lit, _SIZES)), F.col("p_size") % 8 + 1)
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("site"), F.col("p_size").alias("page_id"), value.alias("value")).agg(F.count("*").alias("n"))
    return B.keyed(B.merged_counts(counts), B.FONT_SIZES, "size")


@register("site_font_faces", "SELECT p_type AS site, p_brand AS family, list_sort(list(DISTINCT p_size * 10)) AS weights, list_sort(list(DISTINCT lower(p_name)) FILTER (WHERE p_name <> '')) AS styles FROM part GROUP BY 1, 2")
def site_font_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = table(spark, sf_dir, "part").select(F.col("p_type").alias("site"), F.concat(F.lit(" "), "p_brand").alias("family"), F.concat((F.col("p_size") * 10).cast("string"), F.lit(" normal")).alias("weight"), F.lower("p_name").alias("style"))
    return B.font_faces(faces)


@register(
    "site_breakpoints",
    "WITH b AS (SELECT DISTINCT l_returnflag AS site, CAST(round(b) AS INT) AS px FROM (SELECT l_returnflag, unnest([l_quantity, l_linenumber * 100.4, -1]) AS b FROM lineitem) WHERE b > 0), n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY px) AS k FROM b) SELECT site, coalesce(['sm', 'md', 'lg', 'xl', '2xl', '3xl'][k], 'bp_' || k) AS name, px FROM n",
)
def site_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("site"), F.array(F.col("l_quantity").cast("double"), F.col("l_linenumber") * 100.4, F.lit(-1.0)).alias("breakpoints"))
    return B.responsive_rules(captures)


@register(
    "site_images",
    r"""WITH a AS (SELECT p_type AS site, 'https://cdn.example/' || p_partkey || '.svg' AS source_url, 'assets/' || p_type || '/' || p_name || '.SVG' AS local_path, md5(p_name) AS sha256 FROM part WHERE p_size % 3 > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY source_url, local_path) AS place, regexp_extract(local_path, '([^/]*)\.SVG$', 1) AS stem FROM a)
SELECT site, place, 'img_' || left(regexp_replace(regexp_replace(lower(stem), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 64) AS id, source_url, sha256 FROM n WHERE place <= 500""",
)
def site_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as assets, two thirds of them images."""
    made = table(spark, sf_dir, "part").select(
        F.col("p_type").alias("site"), F.concat(F.lit("https://cdn.example/"), F.col("p_partkey").cast("string"), F.lit(".svg")).alias("source_url"), F.concat(F.lit("assets/"), "p_type", F.lit("/"), "p_name", F.lit(".SVG")).alias("local_path"), F.md5("p_name").alias("sha256"), F.when(F.col("p_size") % 3 > 0, "image").otherwise("font").alias("asset_type")
    )
    return B.image_assets(made).select("site", "place", "id", "source_url", "sha256")


_ICON_SQL = " OR ".join(f"starts_with(class, '{c}')" for c in B.ICON_CLASSES)
_SLUG = "left(regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 64)"


@register(
    "site_icons",
    rf"""WITH a AS (SELECT p_type AS site, 'https://cdn.example/' || p_partkey || '.svg' AS source_url, 'assets/' || p_type || '/' || p_name || '.svg' AS local_path, p_name AS stem FROM part WHERE p_size % 3 > 0 AND p_size % 2 = 0),
d AS (SELECT site, 'img_' || {_SLUG.format("stem")} AS id, 'inline_svg' AS type, NULL AS glyph, row_number() OVER (PARTITION BY site ORDER BY source_url, local_path) AS place FROM a QUALIFY place <= {B.MOST_ICONS}),
c AS (SELECT DISTINCT p_type AS site, CASE p_size % 4 WHEN 0 THEN '{B.ICON_CLASSES[0]}' || lower(p_brand) WHEN 1 THEN '{B.ICON_CLASSES[-1]}' || p_size ELSE lower(p_brand) END AS class FROM part),
g AS (SELECT site, 'icon_' || {_SLUG.format("class")} AS id, 'font_icon' AS type, class AS glyph, {B.MOST_ICONS} + row_number() OVER (PARTITION BY site ORDER BY class) AS place FROM c WHERE {_ICON_SQL}  QUALIFY place <= {2 * B.MOST_ICONS}),
o AS (SELECT site, id, arg_min({{'type': type, 'glyph': glyph}}, place) AS r, min(place) AS spot FROM (SELECT * FROM d UNION ALL SELECT * FROM g) GROUP BY site, id)
SELECT site, id, r.type AS type, r.glyph AS glyph FROM o QUALIFY row_number() OVER (PARTITION BY site ORDER BY spot) <= {B.MOST_ICONS}""",
)
def site_icons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as drawings and as classes of nodes; parts of one name share an id."""
    part, size = table(spark, sf_dir, "part"), F.col("p_size")
    url = F.concat(F.lit("https://cdn.example/"), F.col("p_partkey").cast("string"), F.lit(".svg"))
    assets = part.select(
        F.col("p_type").alias("site"), url.alias("source_url"), F.concat(F.lit("assets/"), "p_type", F.lit("/"), "p_name", F.lit(".svg")).alias("local_path"),
        F.when(size % 2 == 0, "image/svg+xml").otherwise("image/png").alias("mime_type"), F.when(size % 3 > 0, "image").otherwise("font").alias("asset_type"),
    )
    named = F.when(size % 4 == 0, F.concat(F.lit(B.ICON_CLASSES[0]), F.lower("p_brand"))).when(size % 4 == 1, F.concat(F.lit(B.ICON_CLASSES[-1]), size.cast("string"))).otherwise(F.lower("p_brand"))
    return B.icon_assets(assets, part.select(F.col("p_type").alias("site"), named.alias("class")))


@register(
    "site_provenance",
    "WITH o AS (SELECT user_id AS site, event_type AS kind, CAST(floor(value) AS BIGINT) AS ref, min(event_id) AS seq FROM events GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY seq, kind, ref) AS place FROM o) SELECT site, kind, ref, place FROM n WHERE place <= 15",
)
def site_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations of their user's site, each once, the first fifteen."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("site"), F.col("event_type").alias("kind"), F.floor("value").alias("ref"), F.col("event_id").alias("seq"))
    return B.provenance(rows, ["kind", "ref"], most=15)


@register(
    "site_provenance_summary",
    "SELECT o_orderpriority AS site, count(*) AS pages_considered, count(n) AS pages_with_evidence, CAST(coalesce(sum(n), 0) AS BIGINT) AS nodes_observed, count(*) FILTER (WHERE n > 6) AS nodes_truncated FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber > 1 GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1",
)
def site_provenance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("site"), F.col("o_orderkey").alias("page_id"))
    evidence = table(spark, sf_dir, "lineitem").where("l_linenumber > 1").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.count("*").alias("nodes_observed"))
    return B.provenance_summary(pages, evidence.withColumn("truncated", F.col("nodes_observed") > 6))


@register("bounded_evidence")
def bounded_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of every page, cut to 1,500 bytes; the tests hold the cut against a plain one."""
    html = F.col("html")
    evidence = F.to_json(F.struct("page_id", H.links(html).alias("links"), H.images(html).alias("images"), H.headings(html).alias("headings")))
    made = B.bound_evidence(table(spark, sf_dir, "pages").select("page_id", evidence.alias("evidence")), "evidence", 1_500)
    return made.select("page_id", F.octet_length("evidence").alias("n_bytes"), F.contains("evidence", F.lit('"truncated":true')).alias("truncated"), F.md5("evidence").alias("digest"))


@register(
    "artefact_names",
    r"""SELECT page_id, 'responsive/' || regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g') || '/' || page_id || '-mobile_2.png' AS screenshot, 'evidence-' || page_id AS evidence_id, 'bp-' || regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g') || '-v' || (page_id % 9) AS document_id,
CASE WHEN page_id % 3 = 0 THEN 'e' || page_id END AS read_id FROM pages""",
)
def artefact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of artefacts of every page, and the ids that paths of evidence hold."""
    k = F.col("page_id")
    names = B.artefact_names(F.col("url"), k.cast("string"), F.lit("mobile 2"), k % 9)
    path = F.concat(F.when(k % 3 == 0, "v1/e").when(k % 3 == 1, "v1/a/e").otherwise("v1/e."), k.cast("string"), F.when(k % 3 == 2, ".txt").otherwise(".json"))
    return table(spark, sf_dir, "pages").select("page_id", names.alias("n"), B.evidence_id(path).alias("read_id")).select("page_id", "n.*", "read_id")


@register("page_status_labels", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'O' THEN 'Completed' END AS label, CASE o_orderstatus WHEN 'F' THEN 'danger' WHEN 'O' THEN 'success' END AS tone FROM orders")
def page_status_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "completed").otherwise("open").alias("status"))
    return B.with_labels(rows, "page").drop("status")


@register(
    "page_attribute_forms",
    r"""WITH c AS (SELECT page_id, html, list_filter(flatten(list_transform(regexp_extract_all(html, 'class="([^"]*)"', 1), lambda t: string_split_regex(t, '\s+'))), lambda t: t <> '') AS cs FROM pages)
SELECT page_id, len(regexp_extract_all(html, '(?i)<a\b[^>]*href="([^"]+)"', 1)) AS n_links, len(list_distinct(cs)) AS n_classes, true AS password, 'a b' AS about, 2 AS n_scripts FROM c""",
)
def page_attribute_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose attributes are written in double quotes, in single quotes, or bare where that is possible: all read alike."""
    extra = '<meta name="about" content="a b"><input data-type="x" type="password"><script src="/one.js"></script><script async src="/two.js"></script>'
    whole, k = F.concat(F.lit(extra), "html"), F.col("page_id") % 3
    html = F.when(k == 1, F.regexp_replace(whole, r'=\s*"([^"\']*)"', "='$1'")).when(k == 2, F.regexp_replace(whole, r'=\s*"([^"\'\s>=`]+)"', "=$1")).otherwise(whole)
    rows = table(spark, sf_dir, "pages").select("page_id", html.alias("h"))
    return rows.select("page_id", F.size(H.links(F.col("h"))).alias("n_links"), F.size(H.css_classes(F.col("h"))).alias("n_classes"), H.has_password(F.col("h")).alias("password"), H.meta_tags(F.col("h"))["about"].alias("about"), F.size(H.script_sources(F.col("h"))).alias("n_scripts"))
