"""What the trees of pages tell: meanings of nodes, forms, navigation, templates and layouts, triggers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import slugify
from pagewright.operators.dom import _Tree
from pagewright.operators.site import most_frequent

#: Meanings of tags.
MEANING = {"header": "header", "footer": "footer", "nav": "nav", "main": "main", "aside": "sidebar", "section": "section", "article": "article", "form": "form", "a": "link", "button": "button", "img": "image", "ul": "list", "ol": "list", "li": "list-item", "table": "table"}
#: How much is kept of a page.
MOST_FORMS, MOST_CONTROLS, MOST_REGIONS, MOST_ANCHORS, MOST_LIST_DEPTH = 50, 100, 20, 100, 6
FORM = "number int, form_id string, name string, method string, action string, submit string, fields array<struct<name:string,label:string,type:string,required:boolean,placeholder:string,options:array<string>,validations:map<string,string>>>"
NAV = "number int, region string, label string, items array<struct<href:string,text:string,depth:int>>"
_RULES = ("pattern", "min", "max", "minlength", "maxlength", "step")


def meanings(tag: Column, role: Column) -> Column:
    """The role of a node, if it has one, then what its tag means."""
    t = F.lower(tag)
    own = F.when(t.rlike("^h[1-6]$"), "heading")
    for name, meaning in MEANING.items():
        own = own.when(t == name, meaning)
    return F.array_distinct(F.filter(F.array(F.nullif(F.trim(role), F.lit("")), own), lambda x: x.isNotNull()))


def is_visible(display: Column, visibility: Column, opacity: Column, width: Column, height: Column) -> Column:
    """Whether a rendered node can be seen."""
    return (display != "none") & ~visibility.isin("hidden", "collapse") & (opacity > 0) & (width > 0) & (height > 0)


def _text(node: list) -> str:
    """Text of a node and what is in it.  Children's text follows the node's own."""
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        out.append("".join(n[3]))
        stack.extend(reversed(n[2]))
    return " ".join(" ".join(out).split())


def _below(node: list, tags: tuple[str, ...]) -> Iterator[tuple[list, list[list]]]:
    """Nodes of these tags in document order, with their ancestors up to ``node``."""
    stack = [(c, [node]) for c in reversed(node[2])]
    while stack:
        n, above = stack.pop()
        if n[0] in tags:
            yield n, above
        stack.extend((c, [*above, n]) for c in reversed(n[2]))


def page_forms(html: str | None) -> list[tuple]:
    """Rows of FORM for one page."""
    tree = _Tree()
    tree.feed(html or "")
    labels = {n[1]["for"]: _text(n) for n, _ in _below(tree.root, ("label",)) if n[1].get("for")}
    out = []
    for number, (form, _) in enumerate(_below(tree.root, ("form",))):
        if number == MOST_FORMS:
            break
        fields, submit = [], ""
        for at, (node, above) in enumerate(_below(form, ("input", "select", "textarea", "button"))):
            a, kind = node[1], (node[1].get("type") or {"input": "text", "button": "submit"}.get(node[0], node[0])).lower()
            if kind == "submit" and not submit and node[0] in ("input", "button"):
                submit = _text(node) or a.get("value") or ""
            if at >= MOST_CONTROLS or node[0] == "button" or kind in ("submit", "button", "reset", "image"):
                continue
            wrapped = next((_text(n) for n in reversed(above) if n[0] == "label"), "")
            label = labels.get(a.get("id") or "") or wrapped or " ".join((a.get("aria-label") or "").split())
            options = [_text(n) for n, _ in _below(node, ("option",))]
            rules = [(r, a[r][:128]) for r in _RULES if a.get(r)]
            fields.append({"name": a.get("name") or a.get("id") or "", "label": label, "type": kind, "required": "required" in a or a.get("aria-required") == "true", "placeholder": a.get("placeholder") or None, "options": options, "validations": dict(rules)})
        a = form[1]
        out.append((number, a.get("id") or f"form{number}", a.get("name") or "", (a.get("method") or "GET").upper(), a.get("action") or "", submit, fields))
    return out


def page_navigation(html: str | None) -> list[tuple]:
    """Rows of NAV for one page: regions with links, and all nav elements."""
    tree = _Tree()
    tree.feed(html or "")
    out = []
    for number, (region, _) in enumerate(_below(tree.root, ("header", "footer", "nav"))):
        if number == MOST_REGIONS:
            break
        anchors = [(n, above) for n, above in _below(region, ("a",)) if n[1].get("href") is not None][:MOST_ANCHORS]
        items = [{"href": n[1]["href"], "text": _text(n), "depth": sum(x[0] in ("ul", "ol", "li") for x in above[1:][-MOST_LIST_DEPTH:])} for n, above in anchors]
        if items or region[0] == "nav":
            out.append((number, region[0], " ".join((region[1].get("aria-label") or "").split()), items))
    return out


#: Rows in one batch, about.
BATCH_ROWS = 10_000


def _rows(pages: DataFrame, make, schema: str, key: str, html: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for page, text in zip(batch["key"], batch["html"], strict=True):
                rows += [(page, *r) for r in make(text)]
                if len(rows) >= BATCH_ROWS:
                    yield pd.DataFrame(rows, columns=["key", *names])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["key", *names])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(run, f"key {kind}, {schema}").withColumnRenamed("key", key)


def forms(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per form of each page, with its page's key and the columns of FORM."""
    return _rows(pages, page_forms, FORM, key, html)


def navigation(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per region of navigation of each page, with its page's key and the columns of NAV."""
    return _rows(pages, page_navigation, NAV, key, html)


def templates(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """Per page its template and layout, from counts of its nodes: (key, template, layout_id)."""
    n = lambda *tags: F.count_if(F.col("tag").isin(*tags))
    side = F.count_if((F.col("tag") == "aside") | (F.col("role") == "complementary"))
    sums = nodes.groupBy(key).agg(n("form").alias("f"), n("section").alias("s"), n("table").alias("t"), side.alias("a"), n("header").alias("h"), n("footer").alias("o"))
    template = F.when((F.col("f") > 0) & (F.col("s") <= 1), "form").when((F.col("a") > 0) | (F.col("t") > 0), "app").when(F.col("s") >= 2, "landing").otherwise("content")
    parts = F.concat_ws("_", F.lit("layout"), F.when(F.col("h") > 0, "header"), F.when(F.col("a") > 0, "sidebar"), F.when(F.col("o") > 0, "footer"))
    return sums.select(key, template.alias("template"), F.when(parts == "layout", "layout_plain").otherwise(parts).alias("layout_id"))


def default_layout(layouts: DataFrame, by: str) -> DataFrame:
    """The layout most pages of a site have; the smallest of equals."""
    return most_frequent(layouts.select(by, "layout_id"), [by], "layout_id")


def triggers(nodes: DataFrame, by: str) -> DataFrame:
    """Interactions of a site: distinct (component, action) of nodes with ARIA states, columns popup and expanded."""
    action = F.when(F.coalesce("popup", F.lit("")) != "", "open_menu").when(F.col("expanded").isNotNull(), "toggle_expanded")
    return nodes.withColumn("action", action).where("action IS NOT NULL AND component_id IS NOT NULL").select(by, "component_id", "action").distinct()


def table_entities(nodes: DataFrame, by: str) -> DataFrame:
    """Entities that a site's tables may list, named after the table's class: distinct (by, entity)."""
    name = F.coalesce(F.nullif(slugify(F.coalesce(F.get("classes", F.lit(0)), F.lit("entity"))), F.lit("")), F.lit("entity"))
    return nodes.where("tag = 'table'").select(by, name.alias("entity")).distinct()


#: Classes that name a section, how far up they are looked for, and characters of a block of text.
_TELLING = r"(?i)hero|header|footer|nav|card|contact|feature|pricing|cta|testimonial|section"
SECTION_HOPS, LEAST_BLOCK, MOST_BLOCK = 8, 120, 20_000
_MARKDOWN = r"(?:^|\n)#{1,6}\s|(?:^|\n)[-*]\s|\[[^\]]+\]\([^)]+\)|(?:^|\n)>\s"


def section_names(nodes: DataFrame, key: str = "page_id", hops: int = SECTION_HOPS) -> DataFrame:
    """Per node the section it is in: the first telling class of it or of one of its ``hops`` - 1 nearest ancestors, else main.

    Nodes know the ids of their nearest ancestors, so those of a page, which has been
    one value, meet once, in one row, and each looks its nearest ones up.
    """
    telling = F.get(F.filter("classes", lambda c: c.rlike(_TELLING)), F.lit(0))
    own = F.when(telling.isNotNull(), F.coalesce(F.nullif(slugify(telling), F.lit("")), F.lit("section")))
    near = F.reverse(F.slice("path", -F.least(F.size("path"), F.lit(hops - 1)) if hops > 1 else F.lit(1), F.least(F.size("path"), F.lit(hops - 1))))
    rows = nodes.select(key, F.struct("node_id", own.alias("own"), F.when(F.size("path") > 0, near).otherwise(F.array().cast("array<int>")).alias("near")).alias("x"))
    by_page = rows.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("all"))
    above = lambda x: F.get(F.filter(F.transform(x["near"], lambda i: F.get("all", i)["own"]), lambda o: o.isNotNull()), F.lit(0))
    named = F.transform("all", lambda x: F.struct(x["node_id"].alias("node_id"), F.coalesce(x["own"], above(x), F.lit("main")).alias("section")))
    return by_page.select(key, F.explode(named).alias("n")).select(key, "n.*")


def text_blocks(nodes: DataFrame, pages: DataFrame, key: str = "page_id", path: str = "path", most: int | None = MOST_BLOCK) -> DataFrame:
    """Long texts of paragraphs, code and quotations with their section: (key, node_id, id, type, section, content).

    A block has LEAST_BLOCK characters or more and is cut at ``most`` (None: whole);
    ``nodes`` must hold as much of a text.
    """
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    long = nodes.where(F.col("tag").isin("p", "pre", "code", "blockquote")).select(key, "node_id", text.alias("content")).where(F.length("content") >= LEAST_BLOCK)
    cut = (long if most is None else long.withColumn("content", F.substring("content", 1, most))).join(section_names(nodes, key), [key, "node_id"])
    name = F.when(F.col(path) == "/", "home").otherwise(F.coalesce(F.nullif(slugify(F.col(path)), F.lit("")), F.lit("page")))
    both = cut.join(pages.select(key, name.alias("_page")), key)
    ident = F.concat_ws("_", F.lit("block"), "_page", "section", F.col("node_id").cast("string"))
    return both.select(key, "node_id", ident.alias("id"), F.when(F.col("content").rlike(_MARKDOWN), "markdown").otherwise("html").alias("type"), "section", "content")
