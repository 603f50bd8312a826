"""Components of a site out of the trees of its pages, held as rows of nodes.

Every node is classified by its role, tag or classes; siblings that repeat collapse
into one component, whose first instance stands for all.  A node's place in the
order of discovery is the list of its ancestors' places, so the tree need not be
walked: what a node belongs to follows from its ancestors, and the numbering of a
site from sorting those lists over all of its pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.columns import let, record
from pagewright.functions.text import slugify
from pagewright.plans.session import cut_lineage

#: Components of a site, depth of components, instances of a repeated sibling.
MOST_COMPONENTS, MOST_DEPTH, LEAST_REPEATS, MOST_REPEATS = 500, 12, 2, 50
#: Kinds by role and by tag, kinds by a pattern of one class (the first that fits), categories of kinds.
BY_ROLE = {"banner": "Header", "contentinfo": "Footer", "navigation": "Navbar", "main": "Main", "complementary": "Sidebar", "dialog": "Modal", "alertdialog": "Modal", "form": "Form", "search": "Form", "button": "Button", "table": "Table", "grid": "Table", "list": "List"}
BY_TAG = {"header": "Header", "footer": "Footer", "nav": "Navbar", "main": "Main", "aside": "Sidebar", "form": "Form", "dialog": "Modal", "table": "Table", "ul": "List", "ol": "List", "section": "Section", "article": "Article"}
BY_CLASS = (("Modal", "modal dialog"), ("Card", "card"), ("Hero", "hero banner"), ("Navbar", "nav"), ("Header", "header"), ("Footer", "footer"), ("Sidebar", "sidebar"), ("Button", "btn button"), ("Table", "table"))
CATEGORY = {"Header": "layout", "Footer": "layout", "Navbar": "layout", "Main": "layout", "Sidebar": "layout", "Modal": "composite", "Form": "form", "Button": "ui_primitive", "Table": "data_display", "List": "data_display", "Section": "composite", "Article": "composite", "Card": "composite", "Hero": "composite", "Unknown": "composite"}
REPEATABLE = ("article", "li", "div", "section", "a", "button", "tr", "figure", "option")
CONFIDENCE = {"aria_role": 0.95, "aria_attribute": 0.85, "semantic_tag": 0.9, "class_heuristic": 0.6, "repeated_sibling": 0.4}
#: Confidence of what is noted beside a component: that it repeats, that its depth was cut, that components were cut.
REPEATED, CUT = 0.8, 0.5


def _lookup(value: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value)


def _class_pattern(kind: str, words: str) -> str:
    whole = "|".join(f"(^|[-_]){w}($|[-_])" for w in words.split())
    return f"{whole}|navbar|menu" if kind == "Navbar" else whole


def classified(nodes: DataFrame) -> DataFrame:
    """``nodes`` with kind and method: by role, modal attribute, tag, then classes; null for plain nodes."""
    tokens = F.transform("classes", lambda c: F.lower(c))
    some = lambda pattern: F.exists(tokens, lambda t: t.rlike(pattern))
    by_class = F.coalesce(*[F.when(some(_class_pattern(k, w)), k) for k, w in BY_CLASS])
    role, tag = _lookup(F.lower(F.coalesce("role", F.lit(""))), BY_ROLE), _lookup(F.lower("tag"), BY_TAG)
    modal = F.when(F.element_at("attrs", "aria-modal") == "true", "Modal")
    found = ((role, "aria_role"), (modal, "aria_attribute"), (tag, "semantic_tag"), (by_class, "class_heuristic"))
    return nodes.withColumn("_c", F.coalesce(*[F.when(k.isNotNull(), record(kind=k, method=F.lit(m))) for k, m in found])).select("*", "_c.*").drop("_c")


def variants(instances: Column) -> Column:
    """A map of the classes in which some instances (structs with classes, in order) differ from all: the last such class names them."""
    shared = F.aggregate(F.slice(instances, 2, MOST_REPEATS), F.get(instances, F.lit(0))["classes"], lambda s, x: F.array_intersect(s, x["classes"]))

    def named(common: Column) -> Column:
        extra = F.filter(F.transform(instances, lambda x: F.filter(x["classes"], lambda c: ~F.array_contains(common, c))), lambda e: F.size(e) > 0)
        pairs = F.transform(extra, lambda e: record(name=F.element_at(e, -1), value=F.array_join(e, " ")))
        return let(pairs, lambda p: F.map_from_entries(F.transform(F.array_sort(F.array_distinct(F.transform(p, lambda x: x["name"]))), lambda n: record(name=n, value=F.element_at(F.filter(p, lambda x: x["name"] == n), -1)["value"]))))

    return let(shared, named)


def occurrences(nodes: DataFrame, page: str = "page_id") -> DataFrame:
    """Rows of the nodes that make a component on their page, whatever the other pages hold.

    ``nodes`` has page, node_id (from 0, without gaps, siblings in order), parent_id,
    path (ids of all ancestors, from the root), tag, role, classes and attrs.  A page
    is at most as large as what is kept of one; its nodes meet in one row and are
    compared there with their ancestors.  Roots are no components.
    """
    own = classified(nodes.where(F.col(page).isNotNull()))
    inner = F.col("parent_id").isNotNull()
    may_repeat = inner & F.lower("tag").isin(*REPEATABLE)
    signature = F.concat_ws("|", F.coalesce("kind", F.lit("Unknown")), "tag", F.coalesce("role", F.lit("")))
    group = Window.partitionBy(page, "parent_id", "_sig")
    grouped = own.withColumn("_sig", F.when(may_repeat, signature)).withColumns({"_n": F.count("_sig").over(group), "_first": F.min("node_id").over(group), "_all": F.collect_list(F.when(F.col("_sig").isNotNull(), F.struct("node_id", "classes"))).over(group)})
    member = F.coalesce(F.col("_sig").isNotNull() & F.col("_n").between(LEAST_REPEATS, MOST_REPEATS), F.lit(False))
    stands = member & (F.col("node_id") == F.col("_first"))
    told = grouped.withColumns({"member": member, "stands": stands}).withColumn("makes", F.col("stands") | (~F.col("member") & F.col("kind").isNotNull() & inner))
    place = F.when(F.col("stands"), record(late=F.lit(0), sig=F.col("_sig"), at=F.lit(0))).otherwise(record(late=F.lit(1), sig=F.lit(""), at=F.col("node_id")))
    node = record(
        node_id=F.col("node_id"), parent_id=F.col("parent_id"), path=F.col("path"), makes=F.col("makes"), hidden=F.col("member") & ~F.col("stands"), sig=F.when(F.col("stands"), F.col("_sig")), place=place,
        name=F.coalesce("kind", F.lit("Unknown")), method=F.coalesce("method", F.lit("repeated_sibling")), n=F.when(F.col("stands"), F.col("_n")), variants=F.when(F.col("stands"), variants(F.array_sort("_all"))),
    )
    by_page = told.groupBy(page).agg(F.array_sort(F.collect_list(record(i=F.col("node_id"), node=node)), lambda a, b: F.when(a["i"] < b["i"], -1).otherwise(F.when(a["i"] > b["i"], 1).otherwise(0))).alias("all"))

    def seen(x: Column) -> Column:
        n = x["node"]
        return let(F.transform(n["path"], lambda i: F.get("all", i)["node"]), lambda above: let(F.filter(above, lambda a: a["makes"]), lambda makers: _told(n, above, makers)))

    def _told(n: Column, above: Column, makers: Column) -> Column:
        depth = F.size(makers) + 1
        deep = (depth + 1 >= MOST_DEPTH) & F.when(depth + 1 >= MOST_DEPTH, F.exists("all", lambda o: F.coalesce(o["node"]["parent_id"] == n["node_id"], F.lit(False)))).otherwise(False)
        taken = n["makes"] & ~n["hidden"] & ~F.exists(above, lambda a: a["hidden"]) & (depth < MOST_DEPTH)
        keys = F.transform(makers, lambda m: _key(F.col(page), m))
        return F.when(taken, record(node_id=n["node_id"], key=_key(F.col(page), n), above=keys, order=F.concat(F.transform(above, lambda a: a["place"]), F.array(n["place"])), name=n["name"], method=n["method"], n=n["n"], variants=n["variants"], depth=depth, deep=deep))

    return by_page.select(page, F.explode(F.filter(F.transform("all", seen), lambda x: x.isNotNull())).alias("x")).select(page, "x.*")


def _key(page: Column, node: Column) -> Column:
    """What a component is known by: a repeated sibling by its signature on the whole site, any other by its node."""
    return F.coalesce(F.concat(F.lit("*"), node["sig"]), F.concat_ws("/", page.cast("string"), node["node_id"].cast("string")))


@dataclass
class Normalized:
    """components: (site, number, id, name, category, confidence, method, variants, children, page, node_id, n_seen); pages: (site, page, layout_id, roots);
    notes: (site, ref, method, confidence, n); layouts: (site, layout_id, n_pages, header, footer, sidebar, is_default)."""

    components: DataFrame
    pages: DataFrame
    notes: DataFrame
    layouts: DataFrame


def normalize(nodes: DataFrame, pages: DataFrame, page: str = "page_id", site: str = "site", path: str = "path", collate: str | None = None, below_lost: bool = False) -> Normalized:
    """The components of each site, in the order in which its pages, by path and id, show them.

    Components are MOST_COMPONENTS for each site at most, and what lies below one
    that is left out is left out as well; with ``below_lost`` every link between
    components that are kept counts, wherever it stands.  ``pages`` has a row for each page with its
    site and path; nodes of other pages are not read, and pages without nodes have a
    plain layout.  Sites are numbered by the first MOST_COMPONENTS of a sort that
    drops the rest before the shuffle.
    """
    known = pages.select(F.col(page).alias("page"), F.col(site).alias("site"), F.col(path).alias("path"))
    sorted_path = F.collate("path", collate) if collate else F.col("path")
    placed = F.struct(sorted_path.alias("path"), "page", "order")
    found = cut_lineage(occurrences(nodes, page).withColumnRenamed(page, "page").join(known, "page").withColumn("order", placed).drop("path"))
    kept_variants = F.when(F.size("variants") > 0, F.col("order"))
    first = found.groupBy("site", "key").agg(F.min("order").alias("order"), F.min_by(F.struct("page", "node_id", "name", "method"), "order").alias("f"), F.max_by("variants", kept_variants).alias("variants"), F.count("*").alias("n_seen"))
    number = F.row_number().over(Window.partitionBy("site").orderBy("order"))
    named = first.withColumn("number", number).where(F.col("number") <= MOST_COMPONENTS)
    ident = F.concat_ws("_", F.lit("cmp"), slugify(F.col("f.name")), F.col("number").cast("string"))
    made = cut_lineage(named.select("site", "key", "number", ident.alias("id"), "f.*", "variants", "n_seen"))
    lost = first.join(made, ["site", "key"], "left_anti").select("site", "key")
    blocked = found.select("site", "page", "node_id", F.explode("above").alias("key")).join(lost, ["site", "key"]).select("site", "page", "node_id").distinct()
    ids = made.select("site", "key", "id")
    reached = found if below_lost else found.join(blocked, ["site", "page", "node_id"], "left_anti")
    shown = reached.join(ids, ["site", "key"])
    shown = cut_lineage(shown.withColumn("parent", F.element_at("above", F.when(F.size("above") > 0, -1))))
    edges = shown.where("parent IS NOT NULL").groupBy("site", "parent", "id").agg(F.min("order").alias("order"))
    children = edges.groupBy("site", F.col("parent").alias("key")).agg(_in_order("id", "order").alias("children"))  # MOST_COMPONENTS at most
    parts = made.join(children, ["site", "key"], "left")
    category, confidence = _lookup(F.col("name"), CATEGORY), F.element_at(F.create_map(*[F.lit(x) for p in CONFIDENCE.items() for x in p]), F.col("method"))
    components = parts.select(
        "site", "number", "id", "name", category.alias("category"), confidence.alias("confidence"), "method",
        F.coalesce("variants", F.create_map().cast("map<string,string>")).alias("variants"), F.coalesce("children", F.array().cast("array<string>")).alias("children"), "page", "node_id", "n_seen",
    )
    laid, layouts = _pages(known, shown)
    return Normalized(components, laid, _notes(shown, lost), layouts)


def _in_order(value: str, order: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])


def _pages(known: DataFrame, shown: DataFrame) -> tuple[DataFrame, DataFrame]:
    tops = shown.where("parent IS NULL").groupBy("site", "page", "id").agg(F.min("order").alias("order"))
    roots = tops.groupBy("site", "page").agg(_in_order("id", "order").alias("roots"))
    marks = [F.min_by(F.when((F.col("name") == k) & F.col("n").isNull(), F.col("id")), F.when((F.col("name") == k) & F.col("n").isNull(), F.col("order"))).alias(k.lower()) for k in ("Header", "Sidebar", "Footer")]
    slots = shown.groupBy("site", "page").agg(*marks)
    both = known.select("site", "page", "path").join(roots, ["site", "page"], "left").join(slots, ["site", "page"], "left")
    named = F.concat_ws("_", *[F.when(F.col(c).isNotNull(), c) for c in ("header", "sidebar", "footer")])
    layout = F.concat(F.lit("layout_"), F.when(named == "", "plain").otherwise(named))
    laid = both.withColumn("layout_id", layout)
    pages = laid.select("site", "page", "layout_id", F.coalesce("roots", F.array().cast("array<string>")).alias("roots"))
    at = F.struct("path", "page")
    counted = laid.groupBy("site", "layout_id").agg(F.count("*").alias("n_pages"), *[F.min_by(c, at).alias(c) for c in ("header", "footer", "sidebar")])
    best = counted.groupBy("site").agg(F.max_by("layout_id", F.struct("n_pages", F.transform(F.split("layout_id", ""), lambda c: -F.ascii(c)))).alias("best"))
    return pages, counted.join(best, "site").select(*counted.columns, (F.col("layout_id") == F.col("best")).alias("is_default"))


def _notes(shown: DataFrame, lost: DataFrame) -> DataFrame:
    """What is to be said of components: how they were classified, that they repeat, that their depth or number was cut."""
    single = F.col("n").isNull()
    confidence = F.element_at(F.create_map(*[F.lit(x) for p in CONFIDENCE.items() for x in p]), F.col("method"))
    how = F.when(single, record(method=F.col("method"), confidence=confidence)).otherwise(record(method=F.lit("repeated_sibling"), confidence=F.lit(REPEATED)))
    deep = F.when(F.col("deep"), record(method=F.lit("depth_cap"), confidence=F.lit(CUT)))
    each = shown.select("site", F.col("id").alias("ref"), F.explode(F.array_compact(F.array(how, deep))).alias("x")).groupBy("site", "ref", "x.method", "x.confidence").agg(F.count("*").alias("n"))
    cut = lost.groupBy("site").agg(F.count("*").alias("n")).select("site", F.lit("components").alias("ref"), F.lit("component_cap").alias("method"), F.lit(CUT).alias("confidence"), "n")
    return each.unionByName(cut)
