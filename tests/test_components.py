"""Components of sites against a version that walks one page after another."""

import random
from collections import Counter

import pytest

from pagewright.operators import components, dom

NODES = "page_id int, node_id int, parent_id int, depth int, tag string, role string, classes array<string>, attrs map<string,string>, path array<int>"


def plain_kind(node):
    if components.BY_ROLE.get(node["role"].lower()):
        return components.BY_ROLE[node["role"].lower()], "aria_role"
    if node["attrs"].get("aria-modal") == "true":
        return "Modal", "aria_attribute"
    if node["tag"] in components.BY_TAG:
        return components.BY_TAG[node["tag"]], "semantic_tag"
    bits = [set(c.lower().replace("_", "-").split("-")) for c in node["classes"]]
    for kind, words in components.BY_CLASS:
        if any(b & set(words.split()) for b in bits) or (kind == "Navbar" and any("navbar" in c.lower() or "menu" in c.lower() for c in node["classes"])):
            return kind, "class_heuristic"
    return None


def plain_normalize(pages, nodes):
    """pages: (page, site, path); walks each page from its roots down, as a browser's inspector would."""
    out = {}
    for site in {p[1] for p in pages}:
        made, by_signature, edges, notes, roots, slots, cut = [], {}, [], Counter(), {}, {}, 0

        def create(name, method, page, node):
            if len(made) >= components.MOST_COMPONENTS:
                return None
            made.append({"id": f"cmp_{name.lower()}_{len(made) + 1}", "name": name, "method": method, "at": (page, node), "children": [], "variants": {}})
            return made[-1]

        def attach(parent, child, page):
            to = parent["children"] if parent else roots[page]
            if child["id"] not in to:
                to.append(child["id"])

        def walk(page, tree, node, parent, depth):
            below = [n for n in tree if n["parent_id"] == node["node_id"]]
            groups = {}
            for n in below:
                if n["tag"] in components.REPEATABLE:
                    groups.setdefault(f"{(plain_kind(n) or ('Unknown',))[0]}|{n['tag']}|{n['role']}", []).append(n)
            used = set()
            for sig in sorted(groups):
                same = groups[sig]
                if not 2 <= len(same) <= 50:
                    continue
                used |= {n["node_id"] for n in same}
                name, method = plain_kind(same[0]) or ("Unknown", "repeated_sibling")
                one = by_signature.get(sig) or create(name, method, page, same[0]["node_id"])
                if one is None:
                    lost.add(("*", sig))
                    continue
                by_signature[sig] = one
                common = set.intersection(*[set(n["classes"]) for n in same])
                named = {}
                for n in same:
                    extra = [c for c in n["classes"] if c not in common]
                    if extra:
                        named[extra[-1]] = " ".join(extra)
                if named:
                    one["variants"] = named
                attach(parent, one, page)
                notes[one["id"], "repeated_sibling", components.REPEATED] += 1
                if depth + 1 < components.MOST_DEPTH:
                    walk(page, tree, same[0], one, depth + 1)
                elif any(n["parent_id"] == same[0]["node_id"] for n in tree):
                    notes[one["id"], "depth_cap", components.CUT] += 1
            for n in below:
                if n["node_id"] in used:
                    continue
                known = plain_kind(n)
                if known is None:
                    if depth < components.MOST_DEPTH:
                        walk(page, tree, n, parent, depth)
                elif depth < components.MOST_DEPTH:
                    one = create(*known, page, n["node_id"])
                    if one is None:
                        lost.add((page, n["node_id"]))
                        continue
                    attach(parent, one, page)
                    notes[one["id"], known[1], components.CONFIDENCE[known[1]]] += 1
                    if known[0] in ("Header", "Sidebar", "Footer"):
                        slots[page].setdefault(known[0].lower(), one["id"])
                    if depth + 1 < components.MOST_DEPTH:
                        walk(page, tree, n, one, depth + 1)
                    elif any(x["parent_id"] == n["node_id"] for x in tree):
                        notes[one["id"], "depth_cap", components.CUT] += 1

        lost = set()
        layouts = {}
        for page, _, path in sorted((p for p in pages if p[1] == site), key=lambda p: (p[2], p[0])):
            roots[page], slots[page] = [], {}
            tree = [n for n in nodes if n["page_id"] == page]
            for n in tree:
                if n["parent_id"] is None:
                    walk(page, tree, n, None, 1)
            name = "layout_" + ("_".join(s for s in ("header", "sidebar", "footer") if s in slots[page]) or "plain")
            entry = layouts.setdefault(name, [0, slots[page]])
            entry[0] += 1
            roots[page] = (name, roots[page])
        best = max(sorted(layouts), key=lambda n: layouts[n][0])
        out[site] = (made, roots, notes, {n: (c, s.get("header"), s.get("footer"), s.get("sidebar"), n == best) for n, (c, s) in layouts.items()}, bool(lost))
    return out


def forest(seed, pages=14, most=60):
    rng = random.Random(seed)
    rows = []
    for page in range(pages):
        parents = [None]
        n = rng.randint(1, most)
        held = [{"page_id": page, "node_id": 0, "parent_id": None, "depth": 0, "path": []}]
        for node in range(1, n):
            up = held[rng.randrange(max(0, len(held) - 6), len(held))] if rng.random() < 0.8 else held[0]
            held.append({"page_id": page, "node_id": node, "parent_id": up["node_id"], "depth": up["depth"] + 1, "path": [*up["path"], up["node_id"]]})
        # sorted level by level, as pages give them
        held.sort(key=lambda h: (h["depth"], h["node_id"]))
        new = {h["node_id"]: i for i, h in enumerate(held)}
        for h in held:
            h |= {"node_id": new[h["node_id"]], "parent_id": None if h["parent_id"] is None else new[h["parent_id"]], "path": [new[i] for i in h["path"]]}
            h |= {"tag": rng.choice(["div", "div", "li", "p", "section", "nav", "a", "header", "footer", "aside", "table", "span"]), "role": rng.choice(["", "", "", "", "button", "Dialog", "list"])}
            h |= {"classes": rng.sample(["card", "big", "site-header", "x", "red", "main_menu", "Hero"], rng.choice([0, 0, 1, 2])), "attrs": {"aria-modal": "true"} if rng.random() < 0.03 else {}}
        rows += held
        parents.clear()
    return rows


def compare(spark, nodes, pages):
    names = [f.split()[0] for f in NODES.split(", ")]
    table = spark.createDataFrame([tuple(n[c] for c in names) for n in nodes], NODES).repartition(3)
    known = spark.createDataFrame(pages, "page_id int, site string, path string")
    got = components.normalize(table, known)
    want = plain_normalize(pages, nodes)
    rows = {(r["site"], r["number"]): r for r in got.components.collect()}
    assert len(rows) == sum(len(w[0]) for w in want.values())
    for site, (made, roots, notes, layouts, lost) in want.items():
        for i, c in enumerate(made):
            r = rows[site, i + 1]
            assert (r["id"], r["name"], r["method"], (r["page"], r["node_id"]), r["children"], dict(r["variants"])) == (c["id"], c["name"], c["method"], c["at"], c["children"], c["variants"]), (site, i)
            assert r["category"] == components.CATEGORY[r["name"]] and r["confidence"] == components.CONFIDENCE[r["method"]]
        assert {r["page"]: (r["layout_id"], r["roots"]) for r in got.pages.where(f"site = '{site}'").collect()} == roots
        found = Counter({(r["ref"], r["method"], r["confidence"]): r["n"] for r in got.notes.where(f"site = '{site}' AND ref <> 'components'").collect()})
        assert found == notes
        assert got.notes.where(f"site = '{site}' AND method = 'component_cap'").count() == int(lost)
        assert {r["layout_id"]: (r["n_pages"], r["header"], r["footer"], r["sidebar"], r["is_default"]) for r in got.layouts.where(f"site = '{site}'").collect()} == layouts
    return got


@pytest.mark.parametrize(("seed", "most", "depth"), [(1, 500, 12), (2, 9, 12), (3, 500, 3), (4, 25, 2)])
def test_random_trees(spark, monkeypatch, seed, most, depth):
    monkeypatch.setattr(components, "MOST_COMPONENTS", most)
    monkeypatch.setattr(components, "MOST_DEPTH", depth)
    nodes = forest(seed)
    pages = [(p, f"s{p % 2}", f"/{'abc'[p % 3]}") for p in range(15)]  # one page has no nodes
    compare(spark, nodes, pages)


def test_pages_of_the_tables(spark, sf):
    table = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [r.asDict() for r in dom.nodes(table).collect()]
    pages = [(r["page_id"], r["url"].split("/")[2], "/" + r["url"].split("/", 3)[3]) for r in table.collect()]
    compare(spark, rows, pages)


def test_long_groups_and_odd_rows(spark):
    """More than 50 equal siblings are components of their own kind, or none; null roles, no classes, no rows."""
    path = {"attrs": {}, "depth": 1, "path": [0], "parent_id": 0, "page_id": 1}
    root = {"page_id": 1, "node_id": 0, "parent_id": None, "depth": 0, "tag": "html", "role": "", "classes": [], "attrs": {}, "path": []}
    many = [root, *({"node_id": i + 1, "tag": "section", "role": "", "classes": [], **path} for i in range(51)), *({"node_id": i + 52, "tag": "li", "role": "", "classes": [], **path} for i in range(60))]
    got = compare(spark, many, [(1, "s", "/")])
    assert got.components.count() == 51
    empty = spark.createDataFrame([], NODES)
    assert components.normalize(empty, spark.createDataFrame([(1, "s", "/")], "page_id int, site string, path string")).pages.first()["layout_id"] == "layout_plain"


def test_nodes_know_their_ancestors_and_attributes(spark):
    html = "<html><body><div class='a b a' aria-modal=true data-x=1 href=''><p id=" + "y" * 300 + ">x</p></div></body></html>"
    rows = {r["tag"]: r for r in dom.nodes(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()}
    assert rows["p"]["path"] == [0, 1, 2] and rows["html"]["path"] == [] and rows["div"]["classes"] == ["a", "b"]
    assert rows["div"]["attrs"] == {"aria-modal": "true"} and len(rows["p"]["attrs"]["id"]) == 256
    wide = "<p class='" + " ".join(f"c{i}" for i in range(60)) + "'>"
    assert len(dom.nodes(spark.createDataFrame([(1, wide)], "page_id int, html string")).first()["classes"]) == dom.MOST_CLASSES


def test_links_below_components_that_are_left_out(spark, monkeypatch):
    """A nav beyond the bound holds two buttons that repeat, and these a list: both are kept components of other places."""
    node = {"page_id": 1, "role": "", "classes": [], "attrs": {}}
    at = lambda i, up, tag, *path: {**node, "node_id": i, "parent_id": up, "depth": len(path), "tag": tag, "path": list(path)}
    rows = [at(0, None, "html"), at(1, 0, "button", 0), at(2, 0, "button", 0), at(3, 0, "nav", 0), at(4, 3, "button", 0, 3), at(5, 3, "button", 0, 3), at(6, 4, "li", 0, 3, 4), at(7, 4, "li", 0, 3, 4), at(8, 1, "li", 0, 1), at(9, 0, "li", 0), at(10, 0, "li", 0)]
    names = [f.split()[0] for f in NODES.split(", ")]
    table = spark.createDataFrame([tuple(n[c] for c in names) for n in rows], NODES)
    pages = spark.createDataFrame([(1, "s", "/")], "page_id int, site string, path string")
    monkeypatch.setattr(components, "MOST_COMPONENTS", 2)
    children = lambda whole: [r["children"] for r in components.normalize(table, pages, below_lost=whole).components.orderBy("number").collect()]
    assert children(False) == [[], []]
    assert children(True) == [["cmp_unknown_2"], []]
