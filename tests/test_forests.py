"""Trees of paths and nested values against plain versions; sections of nodes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import dom, forest, markup
from pagewright.operators.site import parents_by_depth


def plain_tree(paths):
    root = {}
    for path in paths:
        node = root
        parts = path.split("/")
        for i, part in enumerate(parts):
            node = node.setdefault(part, [{}, False])
            node[1] = node[1] or i == len(parts) - 1
            node = node[0]
    return root


def plain_text(node, indent=""):
    lines = []
    for name in sorted(node):
        below, is_file = node[name]
        lines += [f"{indent}{name}{'/' if below and not is_file else ''}", *plain_text(below, indent + "  ")]
    return lines


def plain_places(node, depth=0, at=None, out=None, before=()):
    at, out = at if at is not None else [0, 0], out if out is not None else {}
    for name in sorted(node):
        path = (*before, name)
        pre = at[0]
        at[0] += 1
        plain_places(node[name][0], depth + 1, at, out, path)
        out["/".join(path)] = (depth, at[0] - pre - 1, pre, at[1])
        at[1] += 1
    return out


def test_trees_of_paths(spark):
    rng = random.Random(1)
    names = ["a", "b", "B", "a.b", "é", "z-1", ""]
    rows = [(rng.choice(["p", "q", None]), "/".join(rng.choice(names) for _ in range(rng.randint(1, 5)))) for _ in range(120)] + [("one", "x")] * 3
    nodes = forest.path_nodes(spark.createDataFrame(rows, "k string, path string"), "k", "path")
    texts = {r["k"]: r["text"] for r in forest.tree_text(nodes, "k").collect()}
    places = {}
    for r in forest.numbered_nodes(nodes, "k").collect():
        places.setdefault(r["k"], {})["/".join(r["segments"])] = (r["depth"], r["n_below"], r["pre"], r["post"])
    for key in {k for k, _ in rows}:
        tree = plain_tree([p for k, p in rows if k == key])
        assert texts[key].split("\n") == plain_text(tree) and places[key] == plain_places(tree), key
    assert forest.tree_text(nodes.limit(0), "k").count() == 0


def plain_menu(items):
    """Items (seq, depth, label) in order: each goes below the last one before it of smaller depth."""
    roots, stack = [], []
    for _, depth, label in items:
        item = {"label": label}
        while stack and stack[-1][1] >= depth:
            stack.pop()
        (stack[-1][0].setdefault("children", []) if stack else roots).append(item)
        stack.append((item, depth))
    return roots


def test_menus_nest_as_their_depths_say(spark):
    rng = random.Random(2)
    rows = [(menu, seq, rng.randint(0, 4), rng.choice(['a"b', "x\\y", "é", "{}"]) + str(seq)) for menu in range(8) for seq in range(rng.randint(1, 25))]
    table = spark.createDataFrame(rows, "menu int, seq int, depth int, label string").repartition(3)
    found = forest.nested(parents_by_depth(table, ["menu"], "seq", "depth", 5), ["menu"], "seq", "parent_seq", "seq", "depth", F.struct("label"), 5)
    got = {r["menu"]: json.loads(r["tree"]) for r in found.collect()}
    assert got == {m: plain_menu([r[1:] for r in rows if r[0] == m]) for m in range(8)}
    with pytest.raises(Exception, match="deeper than 2"):
        forest.nested(parents_by_depth(table, ["menu"], "seq", "depth", 5), ["menu"], "seq", "parent_seq", "seq", "depth", F.struct("label"), 2).collect()


def test_sections_and_blocks(spark):
    long = "word " * 40
    deep = "<div>" * 6
    html = f'<div class="a Big-Hero x"><p>{long}</p><div class="nav-x"><pre># title {long}</pre></div></div><p>{long * 200}</p><p>short</p><section class="???cta"><i><code>{long}</code></i></section><div class="card">{deep}<blockquote>{long}</blockquote>'
    far = f'<div class="card">{deep}<div><blockquote>{long}</blockquote>'
    pages = spark.createDataFrame([(1, html, "/"), (2, far, "/A b/"), (3, None, "/")], "page_id int, html string, path string")
    nodes = dom.nodes(pages, text_chars=markup.MOST_BLOCK)
    got = sorted((r["page_id"], r["id"].rpartition("_")[0], r["type"], r["section"], len(r["content"])) for r in markup.text_blocks(nodes, pages).collect())
    n = len(long.strip())
    assert got == [
        (1, "block_home_big-hero", "html", "big-hero", n),
        (1, "block_home_card", "html", "card", n),
        (1, "block_home_cta", "html", "cta", n),
        (1, "block_home_main", "html", "main", 19_999),
        (1, "block_home_nav-x", "markdown", "nav-x", n + 8),
        (2, "block_a-b_main", "html", "main", n),
    ]
    near = markup.section_names(nodes, hops=1).where("section <> 'main'").count()
    assert near == 5 and markup.section_names(nodes.limit(0)).count() == 0
