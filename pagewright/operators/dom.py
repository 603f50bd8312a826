"""The tree of a page as rows of nodes, in level order."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
MOST_NODES, MOST_DEPTH, OWN_TEXT_CHARS = 5000, 40, 200
SKIPPED = frozenset(("script", "style", "head", "noscript", "template"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
SCHEMA = "node_id int, parent_id int, depth int, tag string, role string, classes array<string>, text string, href string, path array<int>, attrs map<string,string>"
#: Classes and characters of an attribute that are kept, and the attributes.
MOST_CLASSES, ATTRIBUTE_CHARS = 40, 256
ATTRIBUTES = ("id", "href", "src", "alt", "title", "type", "name", "placeholder", "role", "for", "action", "method", "rel", "target", "width", "height", "lang", "dir", "aria-label", "aria-labelledby", "aria-hidden", "aria-expanded", "aria-current", "aria-haspopup", "aria-modal")
#: Component kinds by role, then by tag.
BY_ROLE = {"navigation": "Navigation", "banner": "Header", "contentinfo": "Footer", "main": "Main", "dialog": "Modal", "button": "Button", "search": "Search", "form": "Form", "tablist": "Tabs"}
BY_TAG = {"nav": "Navigation", "header": "Header", "footer": "Footer", "main": "Main", "form": "Form", "button": "Button", "table": "Table", "article": "Article", "section": "Section", "aside": "Sidebar", "dialog": "Modal"}


class _Tree(HTMLParser):
    """Nodes as [tag, attributes, children, own text]; end tags close up to their element, if it is open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["#root", {}, [], []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), [], []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1][3].append(data)


def page_nodes(html: str | None, text_chars: int | None = OWN_TEXT_CHARS, most_nodes: int | None = MOST_NODES, most_depth: int | None = MOST_DEPTH, ancestors: int | None = None) -> list[tuple]:
    """Rows of SCHEMA for one page.  None is no bound; ``path`` has the nearest ``ancestors``, by default all."""
    tree = _Tree()
    tree.feed(html or "")
    out: list[tuple] = []
    queue = deque((c, (), 0) for c in tree.root[2])
    while queue and (most_nodes is None or len(out) < most_nodes):
        (tag, attrs, children, text), path, depth = queue.popleft()
        if tag in SKIPPED or (most_depth is not None and depth > most_depth):
            continue
        number = len(out)
        classes = list(dict.fromkeys((attrs.get("class") or "").split()))[:MOST_CLASSES]
        kept = [(name, attrs[name][:ATTRIBUTE_CHARS]) for name in ATTRIBUTES if attrs.get(name)]
        out.append((number, path[-1] if path else None, depth, tag, attrs.get("role") or "", classes, " ".join("".join(text).split())[:text_chars], attrs.get("href"), list(path), kept))
        below = (*path, number)
        queue.extend((c, below if ancestors is None else below[-ancestors:], depth + 1) for c in children)
    return out


#: Nodes in one batch of rows, about.
BATCH_NODES = 20_000


def nodes(pages: DataFrame, key: str = "page_id", html: str = "html", text_chars: int | None = OWN_TEXT_CHARS, most_nodes: int | None = MOST_NODES, most_depth: int | None = MOST_DEPTH, ancestors: int | None = None) -> DataFrame:
    """One row per node of each page, with its page's key and ``text_chars`` characters of its own text at most.

    None is no bound.  Whole paths of pages of any depth grow with its square, so
    who needs all nodes names how many of the nearest ``ancestors`` a path has, 1 at
    least.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.list_(pa.int32()), pa.map_(pa.string(), pa.string())]

    def made(batch: pa.RecordBatch, owners: list[int], held: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)]
        return pa.record_batch([batch.column("key").take(pa.array(owners, pa.int64())), *columns], ["key", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, held = [], []
            for i, text in enumerate(batch.column("html").to_pylist()):
                rows = page_nodes(text, text_chars, most_nodes, most_depth, ancestors)
                held += rows
                owners += [i] * len(rows)
                if len(held) >= BATCH_NODES:
                    yield made(batch, owners, held)
                    owners, held = [], []
            if held:
                yield made(batch, owners, held)

    kind = pages.schema[key].dataType.simpleString()
    chosen = pages.select(F.col(key).alias("key"), F.col(html).alias("html"))
    return chosen.mapInArrow(run, f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)


def component_kind(tag: Column, role: Column) -> Column:
    """The kind of component that a node is by its role, else by its tag; null for plain ones."""
    out = F.lit(None).cast("string")
    for value, kind in reversed(BY_TAG.items()):
        out = F.when(F.lower(tag) == value, kind).otherwise(out)
    for value, kind in reversed(BY_ROLE.items()):
        out = F.when(F.lower(role) == value, kind).otherwise(out)
    return out


def roots(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Nodes without a parent that is there."""
    known = rows.select(key, F.col("node_id").alias("parent_id"))
    return rows.join(known, [key, "parent_id"], "left_anti")


def sibling_groups(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Groups of 2 to 50 siblings with one tag and role."""
    return rows.groupBy(key, "parent_id", "tag", "role").agg(F.count("*").alias("n")).where(F.col("n").between(2, 50))
