"""The parts of a site's document: routes, components, styles, assets, provenance, and their assembly.

Sites are a column (``site``), so one job makes the documents of all of them.
Lists inside a document are capped by definition; the caps are taken with a
ranking that Spark limits before the shuffle, after equal values are one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.columns import record
from pagewright.functions.labels import title_template
from pagewright.functions.text import box_values, slugify
from pagewright.operators.site import segments, single_position_patterns, suffixed

#: How much a document keeps of each kind.
MOST_PAGES, MOST_ROUTES, MOST_OBSERVATIONS, MOST_IMAGES, MOST_ICONS, MOST_TOKENS, MOST_PER_COMPONENT = 500, 500, 2000, 500, 200, 100, 20
#: What of a page's state makes its route a guarded one.
GUARDED = ("auth_required", "blocked")
LOGIN, LOGOUT, DASHBOARD = r"(?i)/(login|signin|sign-in|auth)(/|$)", r"(?i)/(logout|signout|sign-out)(/|$)", r"(?i)/(dashboard|admin|account|app)(/|$)"
#: Spacing that says nothing; beginnings of the classes of icon fonts; names of breakpoints.
IGNORED_SPACING = ("", "0px", "auto", "normal", "0", "0rem")
ICON_CLASSES = ("fa-", "fas", "far", "fab", "bi-", "mdi-", "material-icons", "glyphicon")
BREAKPOINTS = ("sm", "md", "lg", "xl", "2xl", "3xl")
#: Names of sizes and line heights.
FONT_SIZES = {"0.75rem": "xs", "0.875rem": "sm", "1rem": "base", "1.125rem": "lg", "1.25rem": "xl", "1.5rem": "2xl", "1.875rem": "3xl", "2.25rem": "4xl", "3rem": "5xl"}
LINE_HEIGHTS = {"1.25": "tight", "1.375": "snug", "1.5": "normal", "1.625": "relaxed", "1.75": "relaxed", "2": "loose"}


def first_of(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], most: int) -> DataFrame:
    """The first ``most`` rows per group, with their place."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= most)


# --- pages and routes


def pages_with_evidence(pages: DataFrame, evidence: DataFrame, segmentation: DataFrame) -> DataFrame:
    """Pages that have both evidence and a segmentation, with the columns of these; others are left out."""
    return pages.join(evidence, "page_id").join(segmentation, "page_id")


def path_patterns(paths: DataFrame, site: str = "site", path: str = "path") -> DataFrame:
    """Rows (site, path, pattern) of paths that share all but their last segment with others."""
    groups = single_position_patterns(paths, site, path).where(F.col("position") == F.col("depth") - 1)
    s = segments(F.col(path))
    rest = F.array_join(F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.lit("*"))), "/")
    known = paths.select(site, path).distinct().where(F.size(s) > 0).select(site, path, F.size(s).alias("depth"), rest.alias("rest"))
    return known.join(groups.select(site, "depth", "rest", "pattern"), [site, "depth", "rest"]).select(site, path, "pattern")


def page_rows(pages: DataFrame, patterns: DataFrame) -> DataFrame:
    """The page inventory: rows (site, page_id, path, id, place, is_dynamic, route, auth_required), in the order of path.

    An id is named after the path; the second and later of a name are numbered.
    A path with a pattern is dynamic, and the pattern is its route.  Each page's
    route is kept, whether it is the first or not.
    """
    base = F.when(F.col("path") == "/", "page_home").otherwise(F.concat(F.lit("page_"), F.coalesce(F.nullif(slugify(F.col("path")), F.lit("")), F.lit("root"))))
    kept = first_of(pages.withColumn("base", base), ["site"], ["path", "page_id"], MOST_PAGES)
    named = suffixed(kept, ["site"], "base", ["path", "page_id"], "_")
    joined = named.join(patterns, ["site", "path"], "left")
    return joined.select("site", "page_id", "path", F.col("unique_name").alias("id"), "place", F.col("pattern").isNotNull().alias("is_dynamic"), F.coalesce("pattern", "path").alias("route"), F.coalesce(F.col("auth_status").isin(*GUARDED), F.lit(False)).alias("auth_required"))


def routes(rows: DataFrame) -> DataFrame:
    """Routes of a site: of each path the first page, in the order of pages: (site, route, id, is_dynamic, auth_required, place)."""
    first = rows.groupBy("site", "route").agg(F.min_by(F.struct("id", "is_dynamic", "auth_required", "place"), "place").alias("r"))
    return first_of(first.select("site", "route", "r.id", "r.is_dynamic", "r.auth_required", F.col("r.place").alias("page_place")), ["site"], ["page_place"], MOST_ROUTES).drop("page_place")


def authentication(pages: DataFrame) -> DataFrame:
    """Per site how visitors sign in: (site, type, protected, login_route, logout_route, dashboard_route)."""
    path = F.when(F.col("auth_status").isin(*GUARDED), F.col("path"))
    least = lambda pattern: F.min(F.when(path.rlike(pattern), path))
    sums = pages.groupBy("site").agg(F.array_sort(F.collect_set(path)).alias("protected"), least(LOGIN).alias("login_route"), least(LOGOUT).alias("logout_route"), least(DASHBOARD).alias("dashboard_route"))
    return sums.select("site", F.when(F.size("protected") > 0, "cookie_session").otherwise("none").alias("type"), "protected", "login_route", "logout_route", "dashboard_route")


# --- components


def page_components(pages: DataFrame, files: DataFrame) -> DataFrame:
    """The files of the root components of each page, in their order: (page_id, place, component_id, file); unknown ones are left out."""
    roots = pages.select("page_id", F.posexplode("root_component_ids").alias("place", "component_id"))
    return roots.join(files.select("component_id", "file"), "component_id").select("page_id", "place", "component_id", "file")


def dangling_children(components: DataFrame, by: str = "site") -> DataFrame:
    """Children that no component of the site has as its id: (site, component_id, child)."""
    children = components.select(by, "component_id", F.explode("children").alias("child")).distinct()
    known = components.select(by, F.col("component_id").alias("child"))
    return children.join(known, [by, "child"], "left_anti").select(by, "component_id", "child")


def child_names(components: DataFrame) -> DataFrame:
    """Names of the children of each component, each once, in the order of the first: (component_id, names); unknown ones are left out."""
    children = components.select("component_id", F.posexplode("children").alias("place", "child"))
    names = components.select(F.col("component_id").alias("child"), "name").where("name <> ''")
    first = children.join(names, "child").groupBy("component_id", "name").agg(F.min("place").alias("place"))
    lists = first.groupBy("component_id").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("n"))
    return lists.select("component_id", F.transform("n", lambda x: x["name"]).alias("names"))


def component_payloads(components: DataFrame, overrides: DataFrame, interactions: DataFrame, fragments: DataFrame) -> DataFrame:
    """What is asked for each component: its children's names, overrides and interactions (some), markup if there is any.

    ``overrides`` has (component_id, seq, breakpoint, action), ``interactions``
    (component_id, seq, event, action), ``fragments`` (component_id, markup).
    """

    def listed(rows: DataFrame, fields: list[str], name: str) -> DataFrame:
        kept = first_of(rows, ["component_id"], ["seq"], MOST_PER_COMPONENT)
        lists = kept.groupBy("component_id").agg(F.array_sort(F.collect_list(F.struct("place", *fields))).alias("l"))
        return lists.select("component_id", F.transform("l", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))

    parts = [child_names(components), listed(overrides, ["breakpoint", "action"], "overrides"), listed(interactions, ["event", "action"], "interactions"), fragments.select("component_id", "markup")]
    return reduce(lambda left, part: left.join(part, "component_id", "left"), parts, components.select("component_id", "name"))


def required_props(files: DataFrame, components: DataFrame) -> DataFrame:
    """The required props of each component file by the site's own description: (component_id, attrs); empty where that is unknown.

    ``components`` has props, an array of (name, required, literal).
    """
    attrs = F.array_join(F.transform(F.filter("props", lambda p: p["required"]), lambda p: F.concat(p["name"], F.lit("={"), p["literal"], F.lit("}"))), " ")
    return files.select("component_id").join(components.select("component_id", attrs.alias("attrs")), "component_id", "left").select("component_id", F.coalesce("attrs", F.lit("")).alias("attrs"))


# --- styles


def spacing_counts(styles: DataFrame, by: str = "site") -> DataFrame:
    """Rows (site, page_id, value, n) of the margins, paddings and gaps of a page's nodes; within one property a value counts once."""
    parts = F.concat(*[F.array_distinct(box_values(F.coalesce(c, F.lit("")))) for c in ("margin", "padding", "gap")])
    flat = styles.select(by, "page_id", F.explode(parts).alias("value")).where(~F.col("value").isin(*IGNORED_SPACING))
    return flat.groupBy(by, "page_id", "value").agg(F.count("*").alias("n"))


def merged_counts(counts: DataFrame, by: str = "site") -> DataFrame:
    """Counts of pages added up per site, with their place: most frequent first, then by value."""
    sums = counts.groupBy(by, "value").agg(F.sum("n").alias("n"))
    return sums.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "value")))


def keyed(ranked: DataFrame, scale: dict[str, str], prefix: str, by: str = "site") -> DataFrame:
    """Ranked values (site, value, n, place) with keys: their name on the scale, others ``prefix`` and a number in the order of place.

    Of two values with one name the later has a number as well; numbers are shared.
    """
    name = F.create_map(*[F.lit(x) for pair in scale.items() for x in pair])[F.col("value")]
    named = ranked.where(F.col("place") <= MOST_TOKENS).withColumn("name", name)
    again = F.row_number().over(Window.partitionBy(by, "name").orderBy("place")) > 1
    marked = named.withColumn("again", F.col("name").isNotNull() & again)
    number = F.count_if(F.col("name").isNull() | F.col("again")).over(Window.partitionBy(by).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    key = F.when(F.col("name").isNull(), F.concat_ws("_", F.lit(prefix), number.cast("string"))).when(F.col("again"), F.concat_ws("_", "name", number.cast("string"))).otherwise(F.col("name"))
    return marked.select(by, key.alias("key"), "value", "n")


def font_faces(faces: DataFrame, by: str = "site") -> DataFrame:
    """Fonts of a site from rows (site, family, weight, style): (site, family, weights, styles), each value once."""
    weight = F.try_to_number(F.regexp_extract("weight", r"^\s*([+-]?\d+)", 1), F.lit("S99999")).cast("int")
    rows = faces.select(by, F.trim("family").alias("family"), F.coalesce(weight, F.nullif(F.regexp_extract("weight", r"^\s*(\d+)", 1), F.lit("")).cast("int")).alias("weight"), F.nullif("style", F.lit("")).alias("style")).where("family <> ''").distinct()
    return rows.groupBy(by, "family").agg(F.array_sort(F.collect_set("weight")).alias("weights"), F.array_sort(F.collect_set("style")).alias("styles"))


def responsive_rules(captures: DataFrame, by: str = "site") -> DataFrame:
    """Distinct breakpoints of a site in order, with their names: (site, name, px)."""
    rows = captures.select(by, F.explode("breakpoints").alias("b")).where("b > 0").select(by, F.round("b").cast("int").alias("px")).distinct()
    place = F.row_number().over(Window.partitionBy(by).orderBy("px"))
    names = F.array(*map(F.lit, BREAKPOINTS))
    return rows.withColumn("k", place).select(by, F.coalesce(F.get(names, F.col("k") - 1), F.concat(F.lit("bp_"), F.col("k").cast("string"))).alias("name"), "px")


# --- assets


def _asset_id(kind: str) -> Column:
    stem = F.regexp_replace(F.element_at(F.split("local_path", "/"), -1), r"(?i)\.[a-z0-9]+$", "")
    return F.concat(F.lit("img_"), F.coalesce(F.nullif(slugify(stem), F.lit("")), F.concat(F.lit(f"{kind}_"), (F.col("place") - 1).cast("string"))))


def image_assets(assets: DataFrame, by: str = "site") -> DataFrame:
    """Images of a site in the order of URL and path, some at most: (site, place, id, source_url, local_path, sha256)."""
    kept = first_of(assets.where("asset_type = 'image'"), [by], ["source_url", "local_path"], MOST_IMAGES)
    return kept.select(by, "place", _asset_id("image").alias("id"), "source_url", "local_path", "sha256")


def icon_assets(assets: DataFrame, classes: DataFrame, by: str = "site") -> DataFrame:
    """Icons of a site: drawings among its images, then glyphs of icon fonts among its nodes' classes, each id once: (site, id, type, glyph)."""
    drawn = first_of(assets.where("asset_type = 'image' AND mime_type LIKE 'image/svg%'"), [by], ["source_url", "local_path"], MOST_ICONS)
    drawn = drawn.select(by, _asset_id("image").alias("id"), F.lit("inline_svg").alias("type"), F.lit(None).cast("string").alias("glyph"), "place")
    hit = reduce(lambda a, b: a | b, [F.startswith(F.lower("class"), F.lit(c)) for c in ICON_CLASSES])
    glyphs = first_of(classes.where(hit).select(by, "class").distinct(), [by], ["class"], MOST_ICONS)
    glyphs = glyphs.select(by, F.concat(F.lit("icon_"), slugify(F.col("class"))).alias("id"), F.lit("font_icon").alias("type"), F.col("class").alias("glyph"), (F.col("place") + MOST_ICONS).alias("place"))
    once = drawn.unionByName(glyphs).groupBy(by, "id").agg(F.min_by(F.struct("type", "glyph", "place"), "place").alias("r"))
    return first_of(once.select(by, "id", "r.type", "r.glyph", F.col("r.place").alias("at")), [by], ["at"], MOST_ICONS).select(by, "id", "type", "glyph")


# --- provenance


def provenance(observations: DataFrame, keys: Sequence[str] = ("kind", "ref", "source"), by: str = "site", seq: str = "seq", most: int = MOST_OBSERVATIONS) -> DataFrame:
    """Distinct observations of a site in the order in which they were made, ``most`` at most: (site, keys, place)."""
    once = observations.groupBy(by, *keys).agg(F.min(seq).alias("_seq"))
    return first_of(once, [by], ["_seq", *keys], most).drop("_seq")


def provenance_summary(pages: DataFrame, evidence: DataFrame, by: str = "site") -> DataFrame:
    """Per site: pages considered, pages with evidence, nodes seen, and pages whose nodes were cut."""
    joined = pages.select(by, "page_id").join(evidence.select("page_id", "nodes_observed", "truncated"), "page_id", "left")
    seen = F.col("nodes_observed").isNotNull()
    return joined.groupBy(by).agg(F.count("*").alias("pages_considered"), F.count_if(seen).alias("pages_with_evidence"), F.coalesce(F.sum("nodes_observed"), F.lit(0)).alias("nodes_observed"), F.count_if(F.coalesce("truncated", F.lit(False))).alias("nodes_truncated"))


# --- the document


def site_sections(pages: DataFrame, by: str = "site") -> DataFrame:
    """The site and its search data, after its representative page (home, else the first path): (site, name, description, title_template, open_graph)."""
    order = F.struct(F.col("path") != "/", "path", "page_id")
    best = pages.groupBy(by).agg(F.min_by(F.struct("title", "description"), order).alias("p"))
    name = F.regexp_replace(F.regexp_replace(F.col(by), r":\d+$", ""), r"^www\.", "")
    graph = F.map_filter(F.create_map(F.lit("description"), F.coalesce("p.description", F.lit("")), F.lit("site_name"), name), lambda _, v: v != "")
    return best.select(by, name.alias("name"), F.coalesce("p.description", F.lit("")).alias("description"), title_template(F.col("p.title"), name).alias("title_template"), graph.alias("open_graph"))


def assembled(sites: DataFrame, sections: dict[str, DataFrame], by: str = "site") -> DataFrame:
    """One document per site: (site, document), a JSON object with a list per section, in the order of ``sections``.

    A section has rows (site, ...), in the order of its column place if it has one;
    sites without rows of it have an empty list.
    """
    out = sites.select(by).distinct()
    for name, rows in sections.items():
        fields = [c for c in rows.columns if c not in (by, "place")]
        order = ["place"] if "place" in rows.columns else fields
        lists = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("v")))).alias("l"))
        out = out.join(lists.select(by, F.transform("l", lambda x: x["v"]).alias(f"_{name}")), by, "left")
    return out.select(by, F.to_json(F.struct(F.col(by).alias("site"), *[F.coalesce(f"_{n}", F.array()).alias(n) for n in sections])).alias("document"))


#: Collections of evidence that may be cut, in the order in which equals are cut.
COLLECTIONS = ("nodes", "links", "images", "headings", "nav", "forms", "font_faces")


def bounded(text: str | None, most_bytes: int) -> tuple[str | None, str | None]:
    """An evidence document (JSON) of ``most_bytes`` at most, as far as its lists can be cut, and what is wrong with it.

    A text that is no JSON object stays as it is.  Each list is measured once; what
    is cut is taken off the sum.
    """
    if text is None:
        return None, None
    plain = lambda d: json.dumps(d, ensure_ascii=False, separators=(",", ":"))
    size = lambda d: len(plain(d).encode(errors="surrogatepass"))
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return text, "malformed"
    if not isinstance(found, dict):
        return text, "not an object"
    whole = size(found)
    if whole > most_bytes:
        found["truncated"] = True
        whole = size(found)
        sizes = {c: [size(x) + 1 for x in found[c]] for c in COLLECTIONS if isinstance(found.get(c), list)}
        left = {c: len(x) for c, x in sizes.items()}
        while whole > most_bytes and any(left.values()):
            longest = max(left, key=lambda c: left[c])  # of equals the first
            keep = left[longest] - max(1, -(-left[longest] // 5))
            whole -= sum(sizes[longest][keep : left[longest]]) - (keep == 0)  # the last item has no comma
            left[longest] = keep
        for c, n in left.items():
            found[c] = found[c][:n]
        nodes = [n for n in found.get("nodes") or () if isinstance(n, dict)] if isinstance(found.get("nodes"), list) else []
        present = {str(n.get("id")) for n in nodes}
        for n in nodes:
            n["child_ids"] = [c for c in n.get("child_ids") or () if str(c) in present]
    return plain(found), None if whole <= most_bytes else "too large"


def bound_evidence(rows: DataFrame, column: str, most_bytes: int) -> DataFrame:
    """``rows`` with the documents of ``column`` cut to size, and ``problem``: malformed, not an object, too large, or null.

    As long as a document is too long, its longest collection loses its last fifth;
    then children that are gone are taken out.  Null documents stay null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [bounded(x, most_bytes) for x in batch[column]]
            batch[column], batch["problem"] = [m[0] for m in made], [m[1] for m in made]
            yield batch

    rest = rows.drop("problem")
    return rest.mapInPandas(run, T.StructType([*rest.schema.fields, T.StructField("problem", T.StringType())]))


def artefact_names(scan: Column, page: Column, profile: Column, version: Column) -> Column:
    """Names of what is written for a page and a scan: struct (screenshot, evidence_id, document_id)."""
    safe = lambda c: F.regexp_replace(c, "[^a-zA-Z0-9_-]", "_")
    return record(
        screenshot=F.concat(F.lit("responsive/"), safe(scan), F.lit("/"), safe(page), F.lit("-"), safe(profile), F.lit(".png")),
        evidence_id=F.concat(F.lit("evidence-"), safe(page)),
        document_id=F.concat(F.lit("bp-"), safe(scan), F.lit("-v"), version.cast("string")),
    )


def evidence_id(path: Column) -> Column:
    """The id in the path of an evidence file; null if it is no such path."""
    found = F.regexp_extract(F.regexp_replace(path, "^v1/", ""), r"(?s)^([^/\\]+)\.json$", 1)
    return F.when((found != "") & ~found.isin(".", ".."), found)


#: Labels and tones of states.
STATUS_LABELS = (
    ("project", "idle", "Idle", "neutral"),
    ("project", "scanning", "Scanning", "brand"),
    ("project", "blueprint_ready", "Blueprint ready", "brand"),
    ("project", "generating", "Generating", "warning"),
    ("project", "completed", "Completed", "success"),
    ("project", "error", "Error", "danger"),
    ("scan", "pending", "Pending", "neutral"),
    ("scan", "in_progress", "In progress", "brand"),
    ("scan", "completed", "Completed", "success"),
    ("scan", "failed", "Failed", "danger"),
    ("scan", "cancelled", "Cancelled", "warning"),
    ("page", "completed", "Completed", "success"),
    ("page", "failed", "Failed", "danger"),
    ("page", "timeout", "Timeout", "warning"),
    ("page", "skipped", "Skipped", "neutral"),
)


def with_labels(rows: DataFrame, kind: str, status: str = "status") -> DataFrame:
    """``rows`` with label and tone of their state; null for unknown states."""
    labels = rows.sparkSession.createDataFrame([x[1:] for x in STATUS_LABELS if x[0] == kind], "_status string, label string, tone string")
    return rows.join(F.broadcast(labels), F.col(status) == F.col("_status"), "left").drop("_status")
