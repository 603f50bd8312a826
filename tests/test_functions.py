"""Facts about URLs, addresses, paths, texts and detection."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import html as H
from pagewright.functions import text as T
from pagewright.functions import urls as U
from pagewright.operators import detect as D
from pagewright.operators.rules import RULES, builtin, rule_rows


def values(spark, rows, make, kind="string"):
    """``make`` of each value, in order."""
    table = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r["x"] for r in table.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalize_url(spark):
    facts = {
        "https://example.com/page#section": "https://example.com/page",
        "https://example.com/?utm_source=a&fbclid=b&gclid=c&ref=d&_ga=e&mc_eid=f&id=5": "https://example.com/?id=5",
        "https://example.com/?b=2&a=1": "https://example.com/?a=1&b=2",
        "https://EXAMPLE.com/about/": "https://example.com/about",
        "https://example.com": "https://example.com/",
        "https://example.com:443/a/../b/./c": "https://example.com/b/c",
        "http://example.com:8080/a": "http://example.com:8080/a",
        "https://example.com/é b": "https://example.com/%C3%A9%20b",
        "https://example.com/?q=a b~&UTM_x=1": "https://example.com/?q=a+b%7E",
        "garbage": None,
        "": None,
        None: None,
        "https:///x": None,
    }
    assert values(spark, list(facts), lambda c: U.normalize_url(c)) == list(facts.values())


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab/.?=&#%é :utm_", max_size=25), min_size=20, max_size=20))
def test_normalize_url_is_idempotent(spark, tails):
    urls = [f"https://Example.com/{t}" for t in tails]
    once = values(spark, urls, lambda c: U.normalize_url(c))
    assert values(spark, once, lambda c: U.normalize_url(c)) == once


def test_resolve_url(spark):
    base = F.lit("https://example.com/a/b?x=1")
    facts = {"../c": "https://example.com/c", "d": "https://example.com/a/d", "/e/": "https://example.com/e", "//cdn.example.net/x": "https://cdn.example.net/x", "?y=2": "https://example.com/a/b?y=2", "#top": "https://example.com/a/b?x=1", "mailto:a@b": None, "javascript:x": None, "tel:1": None, "  ": None, "HTTP://Other.com": "http://other.com/"}
    assert values(spark, list(facts), lambda c: U.resolve_url(base, c)) == list(facts.values())


def test_scope(spark):
    seed = F.lit("https://example.com/docs/")
    urls = ["https://example.com/docs/a", "https://sub.example.com/docs/a", "http://example.com/docs/a", "https://example.com:8443/docs/a", "https://example.com/docsx", "garbage"]
    assert values(spark, urls, lambda c: U.CrawlScope(base_path="/docs/").classify(c, seed)) == ["internal", "external", "external", "external", "external", "invalid"]
    assert values(spark, urls, lambda c: U.CrawlScope(include_subdomains=True).classify(c, seed))[1] == "internal"


def test_addresses(spark):
    facts = {"2130706433": 2130706433, "0177.0.0.1": 2130706433, "0x7f.0.0.1": 2130706433, "127.1": 2130706433, "256.0.0.1": None, "1.2.3.4.5": None, "": None, "1.2.3": 16908291, "4294967296": None, "a.b": None}
    assert values(spark, list(facts), lambda c: U.parse_ipv4(c)) == list(facts.values())
    assert values(spark, ["127.0.0.1", "8.8.8.8", "169.254.169.254", "169.254.1.1"], lambda c: U.classify_ipv4(U.parse_ipv4(c))) == ["loopback", None, "metadata_service", "link_local"]
    six = {"::1": "loopback", "::": "unspecified", "fc00::1": "unique_local", "fe80::1%eth0": "link_local", "ff02::1": "multicast", "::ffff:10.0.0.1": "private", "2606:4700::1": "", "zz": None, None: None}
    assert values(spark, list(six), lambda c: U.classify_ipv6(c)) == list(six.values())


def test_policy_trusts_only_named_origins(spark):
    urls = ["http://127.0.0.1:3000/", "http://169.254.169.254/", "http://10.0.0.1/"]
    assert values(spark, urls, lambda c: U.screen_url(c, ("http://127.0.0.1:3000", "http://169.254.169.254"))) == [None, "prohibited_ip", "prohibited_ip"]


def test_text(spark):
    assert values(spark, [" Héllo, World! ", "---"], lambda c: T.stable_id(F.lit("p"), c, F.lit("1"))) == ["p_h-llo-world_1", "p_item_1"]
    assert values(spark, ["a  b c\n", None], T.collapse_whitespace) == ["a b c", ""]
    assert values(spark, ["", "a", "foobar"], T.fnv1a) == ["811c9dc5", "e40c292c", "bf9cf968"]
    assert values(spark, ["/", "/About Us/x", "/a/../b"], T.page_file) == ["index.html", "pages/about-us_x.html", "pages/a_x_b.html"]
    assert values(spark, ["a/b", "/a", "a//b", "../a", ""], T.is_safe_relative) == [True, False, False, False, False]
    assert values(spark, ["logo.SVG", "/x/.env", "/a.tar.gz?x", "none"], T.extension) == ["svg", "", "gz", ""]
    assert values(spark, ["a{b[c](d)}", "(]", "", "}{", "((("], __import__("pagewright.streaming.events", fromlist=["balanced"]).balanced) == [True, False, True, False, False]


def test_sealed_text_needs_its_key(spark):
    key, other = T.session_key("a", b"salt"), T.session_key("b", b"salt")
    assert values(spark, ["x", "é"], lambda c: T.unsealed(T.sealed(c, key), key)) == ["x", "é"]
    assert values(spark, ["x"], lambda c: T.unsealed(T.sealed(c, key), other)) == [None]


PAGE = '<html><head><title> A  <b>b</b></title><meta name="Generator" content="WordPress 6.4.2"><meta name="generator" content="late"><script src="/jquery-3.6.0.min.js"></script></head><body class="a b a"><h1>One</h1><h2> </h2><img src="x.png" alt="1"><img src="x.png" alt="2"><a href="/l">l</a><input type="password"></body></html>'


def test_html(spark):
    c = F.lit(PAGE)
    row = spark.range(1).select(H.title(c), H.headings(c), H.images(c), H.meta_tags(c), H.script_sources(c), H.css_classes(c), H.has_password(c), H.has_captcha(c)).first()
    assert row[0] == "A b" and [tuple(h) for h in row[1]] == [(1, "One")] and [tuple(i) for i in row[2]] == [("x.png", "1")]
    assert row[3] == {"generator": "WordPress 6.4.2"} and row[4] == ["/jquery-3.6.0.min.js"] and row[5] == ["a", "b"] and row[6] and not row[7]


def test_confidence(spark):
    assert [r[0] for r in spark.createDataFrame([([0.5, 0.5],), ([1.0],), ([],)], "w array<double>").select(D.confidence(F.col("w"))).collect()] == [0.75, 1.0, 0.0]
    assert values(spark, [0.9, 0.75, 0.6, 0.5, 0.3], D.status, "double") == ["detected", "detected", "probable", "probable", "unknown"]


def test_builtin_rules():
    assert len(RULES) == 66 and len(rule_rows()) == 154
    assert len({r[0] for r in RULES}) == 66


def test_detection(spark):
    rows = [("s", 2, "u2", PAGE), ("s", 1, "u1", PAGE.replace("6.4.2", "6.3")), ("t", 1, "v", "<html></html>")]
    pages = spark.createDataFrame(rows, "scan_id string, page_seq int, page_url string, html string")
    pages = pages.withColumn("headers", F.create_map(F.lit("Server"), F.lit("nginx"))).withColumn("js_globals", F.create_map(F.lit("React"), F.lit(True), F.lit("Vue"), F.lit(False)))
    found = {(r["scan_id"], r["technology_id"]): r for r in D.detect(D.evidence(pages), builtin(spark)).collect()}
    press = found["s", "wordpress"]
    assert (press["version"], press["version_status"], press["confidence"], press["n_pages"], press["first_page"]) == ("6.3", "exact", 0.95, 2, "u1")
    assert found["s", "jquery"]["version"] == "3.6.0"
    assert found["s", "react"]["confidence_status"] == "detected" and ("s", "vuejs") not in found
    # a header matches by its name alone, whatever it says
    assert {"cloudflare", "vercel", "netlify"} <= {t for s, t in found if s == "t"}
    assert found["t", "cloudflare"]["confidence_status"] == "probable" and "partial confidence" in found["t", "cloudflare"]["limitation"]
    again = {(r["scan_id"], r["technology_id"]): r for r in D.detect(D.evidence(pages.orderBy(F.desc("page_seq"))), builtin(spark)).collect()}
    assert again == found


@pytest.mark.parametrize(("failed", "captcha", "status", "wall", "session", "want"), [(True, True, 200, True, True, "unknown"), (False, True, 401, True, True, "blocked"), (False, False, 429, False, True, "blocked"), (False, False, 200, True, True, "auth_required"), (False, False, 200, False, True, "authenticated"), (False, False, 200, False, False, "public")])
def test_page_auth(spark, failed, captcha, status, wall, session, want):
    assert spark.range(1).select(H.page_auth(F.lit(failed), F.lit(captcha), F.lit(status), F.lit(wall), F.lit(session))).first()[0] == want


def test_code_checks_of_odd_texts(spark):
    from pagewright.streaming import events

    deep = "(" * 200_000 + ")" * 200_000
    assert values(spark, [deep, deep + ")", "(" * 100_000, "([)]", None], events.balanced) == [True, False, False, False, None]
    rows = spark.createDataFrame([(r"const a\E(b = 1", r"a\E(b"), ("function f (", "f"), ("let $x: T", "$x"), ("const ab = 1", "a"), (r"const \Qx = 1", r"\Qx")], "code string, name string")
    assert [r[0] for r in rows.select(events.declares(F.col("code"), F.col("name"))).collect()] == [True, True, True, False, True]


def test_parents_of_rows_that_are_too_deep(spark):
    from pagewright.operators.site import parents_by_depth

    rows = spark.createDataFrame([(1, i, i) for i in range(15)], "k int, seq int, depth int")
    assert [r["parent_seq"] for r in parents_by_depth(rows, ["k"], "seq", "depth", 20).orderBy("seq").collect()] == [None, *range(14)]
    with pytest.raises(Exception, match="deeper than 10"):
        parents_by_depth(rows, ["k"], "seq", "depth", 10).collect()
