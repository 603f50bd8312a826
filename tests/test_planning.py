"""Plans and summaries on small tables with nulls, ties and nothing at all."""

from pyspark.sql import functions as F

from pagewright.operators import planning as P


def test_source_urls_and_eligible_pages(spark):
    rows = [("s", 1, "completed", 1, "/b", "u1"), ("s", 2, "completed", 0, "/z", "u2"), ("s", 3, "completed", 0, "/a", "u3"), ("s", 4, "failed", 0, "/", "u4"), ("s", 0, "completed", 0, "/a", "u5"), ("t", 9, None, 0, "/", "u6")]
    pages = spark.createDataFrame(rows, "site string, page_id int, status string, depth int, path string, url string")
    assert [tuple(r) for r in P.source_urls(P.eligible_pages(pages), "site").collect()] == [("s", "u5")]


def test_targets_and_profiles(spark):
    rows = spark.createDataFrame([("a", f"c{i:02}", i // 2) for i in range(9)] + [("b", "c00", 5)], "site string, id string, at int")
    assert [r["id"] for r in P.targets(rows, "site", "at", most=3).where("site = 'a'").orderBy("id").collect()] == ["c00", "c01", "c02"]
    wanted = spark.createDataFrame([("a", "c05"), ("a", "c05"), ("a", "nobody")], "site string, id string")
    assert [tuple(r)[:2] for r in P.targets(rows, "site", "at", wanted).collect()] == [("a", "c05")]
    profiles = spark.createDataFrame([("mobile", 0), ("tablet", 1)], "name string, place int")
    owners, asked = spark.createDataFrame([("x",), ("y",), ("z",), ("x",)], "k string"), spark.createDataFrame([("x", "tablet"), ("x", "tablet"), ("z", "watch")], "k string, name string")
    got = sorted((r["k"], r["name"]) for r in P.resolved_profiles(profiles, asked, "k", owners).collect())
    assert got == [("x", "tablet"), ("y", "mobile"), ("y", "tablet")]
    assert P.resolved_profiles(profiles, None, "k", owners).count() == 6


def test_comparisons_and_totals(spark):
    wanted = spark.createDataFrame([(i, "p") for i in range(4)], "page int, profile string")
    one, two = spark.createDataFrame([(0, "p", "a"), (1, "p", "a"), (1, "p", "b"), (2, "q", "a")], "page int, profile string, path string"), spark.createDataFrame([(0, "p", "g"), (3, "p", "g")], "page int, profile string, path string")
    got = {r["page"]: (r["original"], r["skipped_reason"]) for r in P.comparisons(wanted, one, two, ["page", "profile"]).collect()}
    assert got == {0: ("a", None), 1: ("a", P.NO_GENERATED), 2: (None, P.NO_ORIGINAL), 3: (None, P.NO_ORIGINAL)}
    rows = [("r", True, 50.005, 1, 10, False), ("r", True, 50.0, 2, 20, False), ("s", False, 0.0, 9, 9, True), ("t", True, 1.0, 1, 1, True)]
    table = spark.createDataFrame(rows, "report string, compared boolean, similarity double, mismatched long, total long, resized boolean")
    got = {r["report"]: tuple(r)[1:] for r in P.diff_totals(table, "report").collect()}
    assert got == {"r": (2, 2, 0, 50.0, 3, 30, False), "s": (1, 0, 1, 0.0, 0, 0, True), "t": (1, 1, 0, 1.0, 1, 1, True)}
    assert P.diff_totals(table.limit(0), "report").count() == 0


def test_document_plans(spark):
    catalogue = spark.createDataFrame([("READ", True, 0), ("TEST", True, 1), ("DB", False, 2), ("API", False, 3), ("SEC", False, 4), ("DEP", False, 5)], "name string, required boolean, place int")
    rows = [("s", "TEST", False, None, None), ("s", "DB", True, True, True), ("s", "API", None, None, True), ("s", "SEC", False, False, True), ("s", "DEP", True, None, None), ("t", "other", None, None, None)]
    said = spark.createDataFrame(rows, "k string, name string, include boolean, exclude boolean, relevant boolean")
    got = {(r["k"], r["name"]): r["reason"] for r in P.planned_documents(catalogue, said, "k").collect()}
    assert {n: r for (k, n), r in got.items() if k == "s"} == {"READ": "required", "TEST": None, "DB": None, "API": "relevant", "SEC": None, "DEP": "opted_in"}
    assert {n: r for (k, n), r in got.items() if k == "t"} == {"READ": "required", "TEST": "required", "DB": None, "API": None, "SEC": None, "DEP": None}
    docs, sources = spark.createDataFrame([("s", "README.md"), ("s", "Api.md"), ("t", "README.md")], "k string, name string"), spark.createDataFrame([("s", "readme.MD")], "k string, name string")
    assert sorted(tuple(r) for r in P.documents_not_in(docs, sources, "k").collect()) == [("s", "Api.md"), ("t", "README.md")]


def test_groups_expiry_totals_and_collisions(spark):
    files = spark.createDataFrame([("p", x) for x in ("a/b", "a/c/d", "top", "b/x", "/odd")], "k string, path string")
    assert sorted((r["name"], r["n"]) for r in P.top_level_groups(files, "k").collect()) == [("", 1), ("(root)", 1), ("a", 2), ("b", 1)]
    cookies = spark.createDataFrame([("s", 5.0), ("s", -1.0), ("s", 0.0), ("s", float("nan")), ("s", float("inf")), ("s", None), ("t", -1.0), ("u", 7.5)], "k string, expires double")
    assert {r["k"]: r["expires"] for r in P.session_expiry(cookies, "k").collect()} == {"s": 5.0, "t": None, "u": 7.5}
    pages = spark.createDataFrame([("s", x) for x in ("loaded", "loaded", "queued", "failed", "blocked", "auth_required", "fatal")], "k string, status string")
    assert tuple(P.crawl_totals(pages, "k").first()) == ("s", 7, 6, 2, 1, 1, 1)
    paths = spark.createDataFrame([("s", i, p) for i, p in enumerate(["a", "B", "b", "A", "c"])] + [("t", 0, "x")], "k string, i int, path string")
    assert [tuple(r) for r in P.first_of_case(paths, "k", "i").select("k", F.col("path")).collect()] == [("s", "b")]
