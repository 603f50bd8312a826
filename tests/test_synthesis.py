"""Offline copies, forms and navigation, component graphs, names, nested JSON."""

import re
from collections import Counter
from html import unescape

from pyspark.sql import functions as F

from pagewright.functions import json_text, labels
from pagewright.operators import documents, dom, images, markup, rewrite, technology
from pagewright.plans import copy_queries


def test_rewritten_page(spark):
    html = (
        '<html><head><base href="/z"><script src="https://www.googletagmanager.com/x.js"></script></head><body>'
        '<a href="/b#top">b</a><a href="https://out.example/x">o</a><a href="mailto:x@y">m</a><a href="#here">h</a>'
        "<img src='/i.png' srcset=\"/i.png 1x, /none.png 2x\"><script src=/s.js></script></body></html>"
    )
    pages = spark.createDataFrame([("s", 1, "https://a.example/", html, "pages/a.html"), ("s", 2, "https://a.example/n", None, "pages/n.html"), ("t", 3, "https://b.example/", "<p>x</p>", "index.html")], "scan_id string, page_id int, url string, html string, file string")
    files = spark.createDataFrame([("s", "https://a.example/b", "pages/b.html"), ("s", "https://a.example/i.png", "assets/i.png"), ("s", "https://a.example/s.js", "assets/s.js"), ("s", "https://a.example/b", "pages/c.html")], "scan_id string, url string, file string")
    got = {r["page_id"]: r["html"] for r in rewrite.rewritten_pages(pages, files).collect()}
    assert got[1] == (
        '<html><head><script src="../mock-client.js"></script></head><body>'
        '<a href="../pages/b.html#top">b</a><a href="https://out.example/x" target="_blank" rel="noopener noreferrer">o</a><a href="mailto:x@y">m</a><a href="#here">h</a>'
        '<img src="../assets/i.png" srcset="../assets/i.png 1x, /none.png 2x"><script src="../assets/s.js"></script></body></html>'
    )
    assert got[2] is None
    assert got[3] == '<p>x</p><script src="mock-client.js"></script>'
    assert rewrite.rewritten_pages(pages.limit(0), files).count() == 0


def test_forms_and_navigation(spark):
    html = '<header><a href="/h"> H </a></header><form><input name="q" aria-label="Find"><input type="submit" value="Go"></form><footer><p>no links</p></footer>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")
    (form,) = markup.forms(pages).collect()
    assert (form["form_id"], form["method"], form["submit"], form["action"]) == ("form0", "GET", "Go", "")
    assert [(f["name"], f["label"], f["type"], f["required"], f["placeholder"], f["validations"]) for f in form["fields"]] == [("q", "Find", "text", False, None, {})]
    (nav,) = markup.navigation(pages).collect()
    assert (nav["region"], [(i["href"], i["text"], i["depth"]) for i in nav["items"]]) == ("header", [("/h", "H", 0)])


def plain_regions(html):
    """Regions of one page by a scan over its tags, for pages whose tags are all closed."""
    out, regions, lists, link = [], [], [], None
    for tag in re.finditer(r"<(/?)(nav|header|footer|ul|ol|li|a)\b([^>]*)>|([^<]+)|<[^>]*>", html):
        close, name, rest, text = tag.groups()
        if text and link:
            link[1] += unescape(text)
        elif name in ("nav", "header", "footer"):
            if close:
                regions.pop()
            else:
                label = re.search(r'aria-label="([^"]*)"', rest)
                out.append([len(out), name, unescape(label[1]) if label else "", []])
                regions.append((out[-1], len(lists)))
        elif name == "a":
            href = re.search(r'href="([^"]*)"', rest)
            link = None if close or not href else [unescape(href[1]), ""]
            for region, outer in regions if link else ():
                region[3].append((link, len(lists) - outer))
        elif name:
            lists.pop() if close else lists.append(name)
    return [(n, r, label, ",".join(f"{a[0]}:{' '.join(a[1].split())}:{d}" for a, d in items)) for n, r, label, items in out if items or r == "nav"]


def test_regions_and_forms_of_the_real_pages(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    want = Counter((k, *x) for k, html in pages.items() for x in plain_regions(html))
    assert len({x[0] for x in want}) == len(pages)
    assert Counter(tuple(r) for r in copy_queries.page_regions(spark, sf).select("page_id", "number", "region", "label", "items").collect()) == want
    forms = Counter((r["page_id"], r["number"] is not None) for r in copy_queries.page_form_rows(spark, sf).collect())
    assert forms == Counter((k, n > 0) for k, html in pages.items() for n in [len(re.findall(r"(?i)<form[\s>]", html))] for _ in range(n or 1))


def test_regions_and_forms_of_odd_pages(spark, tmp_path):
    own = copy_queries._NAV + copy_queries._FORM + '<form action="/q"><input name="q"></form><footer><a href="/t">T &amp; c</a></footer><nav></nav>'
    spark.createDataFrame([(1, own), (2, None), (3, "<p>x</p>")], "page_id int, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = copy_queries.page_regions(spark, str(tmp_path)).collect()
    assert sorted((r["page_id"], r["number"], r["region"], r["label"], r["items"]) for r in got) == [(1, 0, "nav", "Main", "/a:A:2,/b:B b:4"), (1, 1, "footer", "", "/t:T & c:0"), (1, 2, "nav", "", "")]
    got = sorted((r["page_id"], r["number"] or 0, r["form_id"], r["method"], r["action"], r["submit"], r["fields"]) for r in copy_queries.page_form_rows(spark, str(tmp_path)).collect())
    assert got == [
        (1, 0, "f", "POST", "/go", "Send it", "mail:Mail:email:true,s:Size S M:select:false,k::hidden:false"),
        (1, 1, "form1", "GET", "/q", "", "q::text:false"),
        (2, 0, None, None, None, None, None),
        (3, 0, None, None, None, None, None),
    ]


def test_templates_layouts_and_meanings(spark):
    pages = spark.createDataFrame([(1, "<header></header><section></section><section></section>"), (2, "<aside></aside><footer></footer>"), (3, "<p>x</p>")], "page_id int, html string")
    nodes = dom.nodes(pages)
    got = {r["page_id"]: (r["template"], r["layout_id"]) for r in markup.templates(nodes).collect()}
    assert got == {1: ("landing", "layout_header"), 2: ("app", "layout_sidebar_footer"), 3: ("content", "layout_plain")}
    rows = spark.createDataFrame([("h2", ""), ("a", "button"), ("div", "")], "tag string, role string")
    assert [r[0] for r in rows.select(markup.meanings(F.col("tag"), F.col("role"))).collect()] == [["heading"], ["button", "link"], []]
    seen = spark.createDataFrame([("block", "visible", 1.0, 2, 2), ("none", "visible", 1.0, 2, 2), ("block", "collapse", 1.0, 2, 2), ("block", "visible", 0.0, 2, 2), ("block", "visible", 1.0, 0, 2)], "d string, v string, o double, w int, h int")
    assert [r[0] for r in seen.select(markup.is_visible(*map(F.col, "dvowh"))).collect()] == [True, False, False, False, False]


def test_triggers_and_entities(spark):
    nodes = spark.createDataFrame([("s", "c1", "menu", None, "div", ["x"]), ("s", "c1", "menu", "true", "div", []), ("s", "c2", None, "false", "table", ["Order List"]), ("s", None, "menu", None, "table", [])], "site string, component_id string, popup string, expanded string, tag string, classes array<string>")
    assert {tuple(r) for r in markup.triggers(nodes, "site").collect()} == {("s", "c1", "open_menu"), ("s", "c2", "toggle_expanded")}
    assert {tuple(r) for r in markup.table_entities(nodes, "site").collect()} == {("s", "order-list"), ("s", "entity")}


def test_component_graph(spark):
    chain = [("s", f"d{i}", [f"d{i + 1}"]) for i in range(14)] + [("s", "d14", [])]
    rows = [("s", "a", ["b", "gone"]), ("s", "b", ["c"]), ("s", "c", ["b"]), ("s", "x", []), ("s", "x", []), *chain]
    table = spark.createDataFrame(rows, "site string, id string, children array<string>")
    got = {(r["problem"], r["id"]) for r in documents.graph_problems(table).collect()}
    assert {x for x in got if x[0] != "cycle"} == {("unknown_child", "a"), ("duplicate", "x"), ("too_deep", "d12")}
    assert {"b", "c"} <= {i for p, i in got if p == "cycle"} <= {"a", "b", "c"}
    assert documents.graph_problems(table.limit(0)).count() == 0


def test_export_plan(spark):
    files = [("ok", "a.ts", 5), ("ok", "b/c.ts", 6), ("bad", "../x", 1), ("twin", "A.ts", 1), ("twin", "a.ts", 1), ("big", "a.ts", 99)]
    listed = [("ok", "a.ts"), ("big", "a.ts")]
    out = documents.export_plan(spark.createDataFrame(files, "project string, path string, size bigint"), spark.createDataFrame(listed, "project string, path string"), most_bytes=50)
    assert {r["project"]: (r["n_files"], r["reason"]) for r in out.collect()} == {"ok": (2, None), "bad": (1, "unsafe_path"), "twin": (2, "collision"), "big": (1, "too_large")}


def test_technology_rules(spark):
    rows = [("s", "a", "Backend Framework & Server", "Node.js", "18.2.1", 0.9, "detected", ["x"]), ("s", "b", "CMS", "pnpm tools", None, 0.9, None, []), ("t", None, "Analytics & Tracking", "My Stats", None, 0.6, None, ["id UA-12345-6"])]
    table = spark.createDataFrame(rows, "scan_id string, technology_id string, category string, name string, version string, confidence double, confidence_status string, evidence array<string>")
    advice = {r["scan_id"]: (r["node_version"], r["package_manager"], r["target"], r["build_command"]) for r in technology.build_advice(table).collect()}
    assert advice == {"s": ("18.x", "pnpm", "static_spa", "pnpm run build"), "t": ("20.x", "npm", "static_spa", "npm run build")}
    assert [tuple(r) for r in technology.analytics(table).collect()] == [("t", "my-stats", "UA-12345-6")]
    assert {tuple(r[:2]) for r in technology.buckets(table).collect()} == {("s", "runtime"), ("t", "analytics")}


def test_names(spark):
    rows = spark.createDataFrame([("", "3d-view"), ("my card", "x"), ("9 lives", "x"), ("!!", "--")], "name string, id string")
    assert [r[0] for r in rows.select(labels.component_identifier(F.col("name"), F.col("id"))).collect()] == ["Component3dView", "MyCard", "Component9Lives", "Component"]
    paths = spark.createDataFrame([("a/b.tar.GZ?x",), (".env",), ("x.",), ("noext",)], "p string")
    assert [r[0] for r in paths.select(labels.safe_extension(F.col("p"))).collect()] == ["gz", "", "", ""]


def test_nested_json(spark):
    rows = spark.createDataFrame([('{"b":{"password":{"x":1}},"a":[{"Api-Key":"k"}]}',), ("[broken",), (None,), ("3",)], "t string")
    got = [tuple(r) for r in rows.select(json_text.redact_json("t"), json_text.scrub_json("t"), json_text.sorted_json("t")).collect()]
    assert got[0] == ('{"b":{"password":"[redacted]"},"a":[{"Api-Key":"k"}]}', '{"b":{"password":"[redacted]"},"a":[{"Api-Key":"[redacted]"}]}', '{"a":[{"Api-Key":"k"}],"b":{"password":{"x":1}}}')
    assert got[1:] == [(None,) * 3, (None,) * 3, ("3",) * 3]


def test_png_columns(spark):
    rows = spark.createDataFrame([(1, 1, 1, b"\1\2\3\4"), (2, 2, 2, b"\0"), (3, 1, 1, None)], "k int, width int, height int, rgba binary")
    packed = images.encoded(rows, "k")
    got = {r["k"]: (r["width"], r["rgba"] and bytes(r["rgba"]), r["error"]) for r in images.decoded(packed, "k").collect()}
    assert got == {1: (1, b"\1\2\3\4", None), 2: (None, None, "invalid_image"), 3: (None, None, "invalid_image")}
