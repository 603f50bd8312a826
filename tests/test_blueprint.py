"""Parts of a site's document, routes in rounds, running numbers, detection, code checks, streams and tables that are replaced."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagewright.functions import html as H
from pagewright.functions import urls as U
from pagewright.operators import blueprint as B
from pagewright.operators import detect, dom, site
from pagewright.operators.rules import SCHEMA, builtin, rule_rows
from pagewright.plans.session import scratch_path
from pagewright.sources import files
from pagewright.streaming import events


def plain_greedy(paths):
    groups = {}
    for path in sorted(set(paths)):
        s = [x for x in path.split("/") if x]
        for i in range(len(s)):
            groups.setdefault((len(s), i, "/".join([*s[:i], "*", *s[i + 1 :]])), []).append(path)
    used, out = set(), []
    for key, own in sorted(groups.items()):
        values = {[x for x in p.split("/") if x][key[1]] for p in own}
        if len(values) > 1 and used.isdisjoint(own):
            used |= set(own)
            out.append((key[0], key[1], len(own)))
    return sorted(out)


def test_greedy_routes_in_rounds(spark):
    rng = random.Random(7)
    for _ in range(4):
        paths = ["/" + "/".join(rng.choice("abc1") for _ in range(rng.randint(1, 4))) for _ in range(40)]
        table = spark.createDataFrame([("s", p) for p in paths] + [("t", paths[0])], "site string, path string")
        got = site.greedy_patterns(table, "site", "path").collect()
        assert {r["site"] for r in got} == {"s"}
        shape = lambda p: (len(p.split("/")) - 1, next(i for i, x in enumerate(p.split("/")[1:]) if x.startswith(":")))
        assert sorted((*shape(r["pattern"]), r["n_paths"]) for r in got) == plain_greedy(paths)


def test_running_numbers_of_a_hot_group(spark):
    rows = [("hot", i) for i in range(500)] + [("a", i) for i in range(7)] + [(None, 3), ("b", None), ("b", 1)]
    random.Random(2).shuffle(rows)
    table = spark.createDataFrame(rows, "k string, v int").repartition(5)
    got = site.numbered(table, ["k"], ["v"], "n").collect()
    want = []
    for k in {k for k, _ in rows}:
        own = sorted((v for x, v in rows if x == k), key=lambda v: (v is not None, v or 0))
        want += [(k, v, i + 1) for i, v in enumerate(own)]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_signals_as_expressions_and_as_a_relation(spark, monkeypatch):
    html = '<html><head><meta name="generator" content="WordPress 6.1"></head><body class="fa-x flex"><script src=\'https://cdn/jquery-3.6.0.min.js\'></script><a href="/wp-content/x">x</a></body></html>'
    rows = [("s", i, f"http://s/{i}", html if i % 2 else "<p>wp-json</p>", {"Server": "cloudflare", "x-powered-by": "PHP/8.1.2"}, {"React": i == 1}, ["PHPSESSID"], ["#__next"]) for i in range(4)]
    pages = spark.createDataFrame(rows, "scan_id string, page_seq int, page_url string, html string, headers map<string,string>, js_globals map<string,boolean>, cookies array<string>, markers array<string>")
    found = []
    for most in (detect.LITERAL_SIGNALS, 0):
        monkeypatch.setattr(detect, "LITERAL_SIGNALS", most)
        found.append(sorted(map(repr, detect.detect(detect.evidence(pages), builtin(spark)).collect())))
    monkeypatch.undo()
    assert sorted(map(repr, detect.detect_pages(pages, builtin(spark)).collect())) == found[0]
    assert found[0] == found[1] and {"WordPress", "PHP", "jQuery", "Next.js", "Cloudflare"} <= {n for n in ("WordPress", "PHP", "jQuery", "Next.js", "Cloudflare", "Ghost") if any(f"name='{n}'" in r for r in found[0])}
    assert detect.detect(detect.evidence(pages), spark.createDataFrame(rule_rows(()), SCHEMA)).count() == 0


def test_nodes_in_batches(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "<p>" * (i % 5) + "<b class='x y'>t</b>") for i in range(50)] + [(99, None)], "page_id int, html string").coalesce(1)
    want = sorted(map(repr, dom.nodes(pages).collect()))
    monkeypatch.setattr(dom, "BATCH_NODES", 3)
    assert sorted(map(repr, dom.nodes(pages).collect())) == want and len(want) == sum(i % 5 + 1 for i in range(50))


def test_attribute_forms(spark):
    rows = ['<a href="/a">', "<a class=x href='/a'>", "<A data-href=/no HREF=/a>", "<a href=\n\"/a\" >"]
    table = spark.createDataFrame([(r,) for r in rows], "h string")
    assert [r["l"] for r in table.select(H.links(F.col("h")).alias("l")).collect()] == [["/a"]] * 4
    logins = ["<input type='password'>", "<input name=p type=password>", "<INPUT TYPE=\"password\"/>", "<input type=passwords>", "<input data-type='password'>", "<p>type=password</p>"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(logins)], "i int, h string").orderBy("i").select(H.has_password(F.col("h")).alias("p")).collect()
    assert [r["p"] for r in got] == [True, True, True, False, False, False]
    page = "<META property='og:x' content='a \"b\"'><meta content=bare name=n><img src=/i.png alt='it is'><div class='one two' ></div><i class=three></i><script src='https://plausible.io/p.js'></script>"
    r = spark.createDataFrame([(page,)], "h string").select(H.meta_tags(F.col("h")).alias("m"), H.images(F.col("h")).alias("i"), H.css_classes(F.col("h")).alias("c"), H.network_urls(F.col("h")).alias("u"), H.without_trackers(F.col("h")).alias("w")).first()
    assert r["m"] == {"og:x": 'a "b"', "n": "bare"} and [tuple(x) for x in r["i"]] == [("/i.png", "it is")]
    assert r["c"] == ["one", "two", "three"] and r["u"] == ["/i.png", "https://plausible.io/p.js"] and "plausible" not in r["w"]


def test_ip_literals(spark):
    hosts = {"[::1]": (True, "loopback"), "10.0.0.1": (True, "private"), "0x7f.1": (True, "loopback"), "example.com": (False, None), "[2606:4700::1]": (True, None), "::ffff:127.0.0.1": (True, "loopback"), "fe80::1%eth0": (True, "link_local"), "": (False, None)}
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", U.classify_ip_literal(F.col("h")).alias("c")).collect()
    assert {r["h"]: tuple(r["c"]) for r in got} == hosts


def test_page_rows_and_routes(spark):
    pages = [("s", i, p, a) for i, (p, a) in enumerate([("/", "public"), ("/b/1", "blocked"), ("/b/2", "public"), ("/a b", "public"), ("/a-b", "auth_required"), ("/???", None), ("/a b", "public")])]
    table = spark.createDataFrame(pages, "site string, page_id int, path string, auth_status string")
    rows = B.page_rows(table, B.path_patterns(table))
    assert {r["page_id"]: (r["id"], r["route"]) for r in rows.collect()} == {0: ("page_home", "/"), 1: ("page_b-1", "/b/:id"), 2: ("page_b-2", "/b/:id"), 3: ("page_a-b", "/:slug"), 6: ("page_a-b_2", "/:slug"), 4: ("page_a-b_3", "/:slug"), 5: ("page_root", "/:slug")}
    assert [(r["route"], r["id"], r["auth_required"]) for r in B.routes(rows).orderBy("place").collect()] == [("/", "page_home", False), ("/:slug", "page_root", False), ("/b/:id", "page_b-1", True)]
    auth = B.authentication(table).first()
    assert (auth["type"], auth["protected"]) == ("cookie_session", ["/a-b", "/b/1"])


def test_provenance_is_distinct_and_capped(spark):
    rng = random.Random(5)
    rows = [("s", rng.choice("ab"), str(rng.randint(0, 20)), "x", i) for i in range(200)]
    got = [(r["kind"], r["ref"]) for r in B.provenance(spark.createDataFrame(rows, "site string, kind string, ref string, source string, seq int"), most=30).orderBy("place").collect()]
    assert got == list(dict.fromkeys((k, r) for _, k, r, _, _ in rows))[:30]


def test_icons(spark):
    assets = spark.createDataFrame([("s", "http://x/b.svg", "a/Fa home.svg", "image/svg+xml", "image"), ("s", "http://x/a.svg", "a/Fa-home.svg", "image/svg+xml", "image"), ("s", "http://x/c.png", "c.png", "image/png", "image")], "site string, source_url string, local_path string, mime_type string, asset_type string")
    classes = spark.createDataFrame([("s", c) for c in ("fa-star", "FAS", "box", "fa-star", "mdi-x")], "site string, class string")
    got = {(r["id"], r["type"], r["glyph"]) for r in B.icon_assets(assets, classes).collect()}
    assert got == {("img_fa-home", "inline_svg", None), ("icon_fa-star", "font_icon", "fa-star"), ("icon_fas", "font_icon", "FAS"), ("icon_mdi-x", "font_icon", "mdi-x")}


def test_bounded_evidence(spark):
    made = {"nodes": [{"id": f"n{i}", "child_ids": [f"n{i + 1}", "gone"]} for i in range(40)], "links": ["/é"] * 30, "title": "t"}
    text = json.dumps(made, ensure_ascii=False, separators=(",", ":"))
    rows = spark.createDataFrame([(text,), (None,), ('{"title":"' + "x" * 900 + '"}',)], "e string")
    cut, none, long = (r["b"] for r in B.bound_evidence(rows.coalesce(1), "e", 600).select(F.col("e").alias("b")).collect())
    found = json.loads(cut)
    assert none is None and json.loads(long)["truncated"] and len(json.loads(long)["title"]) == 900
    want = json.loads(text)
    while len(json.dumps(want | {"truncated": True}, ensure_ascii=False, separators=(",", ":")).encode()) > 600:
        name = "nodes" if len(want["nodes"]) >= len(want["links"]) else "links"
        want[name] = want[name][: int(len(want[name]) - max(1, -(-len(want[name]) * 2 // 10)))]
    assert (len(found["nodes"]), len(found["links"]), found["truncated"]) == (len(want["nodes"]), len(want["links"]), True)
    assert all(c in {n["id"] for n in found["nodes"]} for n in found["nodes"] for c in n["child_ids"]) and len(cut.encode()) <= 600


def test_icons_of_one_name_are_one(spark):
    assets = spark.createDataFrame([("s", f"http://x/{i}.svg", "a/Same name.svg", "image/svg+xml", "image") for i in range(3)], "site string, source_url string, local_path string, mime_type string, asset_type string")
    classes = spark.createDataFrame([("s", "fa-x y"), ("s", "fa-x-y")], "site string, class string")
    assert sorted((r["id"], r["glyph"]) for r in B.icon_assets(assets, classes).collect()) == [("icon_fa-x-y", "fa-x y"), ("img_same-name", None)]


def test_evidence_that_is_no_object(spark):
    texts = ["{", "[1, 2]", "7", None, '{"nodes": "text", "links": [1, 2, 3]}', '{"nodes": [5, {"id": 1, "child_ids": [1, 2]}], "pad": "' + "x" * 400 + '"}']
    got = {r["k"]: (r["e"], r["problem"]) for r in B.bound_evidence(spark.createDataFrame(list(enumerate(texts)), "k int, e string"), "e", 50).collect()}
    assert got[0] == ("{", "malformed") and got[1] == ("[1, 2]", "not an object") and got[2] == ("7", "not an object") and got[3] == (None, None)
    assert got[4] == ('{"nodes":"text","links":[1,2,3]}', None) and got[5][1] == "too large" and json.loads(got[5][0])["nodes"] == []


def test_status_labels(spark):
    rows = spark.createDataFrame([("completed",), ("odd",), (None,)], "status string")
    for kind in ("project", "scan", "page"):
        assert sorted(map(repr, ((r["label"], r["tone"]) for r in B.with_labels(rows, kind).collect()))) == sorted(map(repr, [("Completed", "success"), (None, None), (None, None)]))


@pytest.mark.parametrize(
    ("code", "problems"),
    [
        ("import React from 'react';\nfunction Card() { return React; }", []),
        ("import React from 'react';\nfunction Card() { return 1; }", ["UNUSED_IMPORT"]),
        ("import { useState as s, type T } from 'x';\nconst Card = () => s<T>(1);", []),
        ("import * as all from 'x'; const Card: X = all.y", []),
        ("const Cards = () => 1", ["MISSING_COMPONENT_DECLARATION"]),
        ("let Card = " + "{" * 41 + "}" * 41, ["EXCESSIVE_NESTING"]),
        ("let Card = " + "{" * 40 + "}" * 40, []),
    ],
)
def test_component_checks(spark, code, problems):
    kept = ("UNUSED_IMPORT", "MISSING_COMPONENT_DECLARATION", "EXCESSIVE_NESTING", "UNBALANCED_DELIMITERS")
    row = spark.createDataFrame([(code,)], "c string").select(events.code_violations(F.col("c"), F.lit("Card")).alias("v")).first()
    assert sorted(x for x in row["v"] if x in kept) == problems


def test_tidy_code(spark):
    code = "import b\nimport a  \n\n\n\nx\t=1\r\n\n\n\ny\n\n"
    row = spark.createDataFrame([(code,), ("",), ("x",)], "c string").select(events.tidy_code(F.col("c")).alias("t")).collect()
    assert [r["t"] for r in row] == ["import a\nimport b\n\nx  =1\n\ny\n", "\n", "x\n"]


def test_stream_gives_up_states(spark):
    """A key that is done, and is quiet for a while, starts anew when it comes again."""
    path = scratch_path(spark, "done-stream")
    kind = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    batches = [[(1, 1, "view", 0), (2, 1, "purchase", 0), (3, 2, "view", 0)], [(4, 3, "view", 60)], [(5, 1, "view", 120), (6, 2, "view", 120)]]
    for rows in batches:
        made = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, minute int")
        ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("minute") * 60)
        made.select("event_id", ts.alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value"), F.lit("").alias("props")).coalesce(1).write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        query = events.fold_scans(source, done_kept=1).writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").foreachBatch(lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{path}/out")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    last = {r["user_id"]: r["s"] for r in spark.read.parquet(f"{path}/out").groupBy("user_id").agg(F.max_by("scanned", "batch").alias("s")).collect()}
    assert last == {1: 1, 2: 2, 3: 1}  # the first view of key 1 went with its state; key 2 was never done


def test_replace_table(spark):
    path = scratch_path(spark, "replaced")
    files.replace_table(spark.range(5), path)
    old = files.read_table(spark, path)
    files.replace_table(old.where("id > 1"), path)  # reads from what it replaces
    assert files.read_table(spark, path).count() == 3 and old.count() == 5
    broken = files.read_table(spark, path).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        files.replace_table(broken, path)
    assert files.read_table(spark, path).count() == 3
    assert len(files.vacuum_table(spark, path)) == 1 and files.read_table(spark, path).count() == 3
