"""Queries on rows and pages that their fixed inputs lack."""

import duckdb
from pyspark.sql import Row

from pagewright.plans import registry
from pagewright.streaming.runs import Runs


def test_first_of_equal_pages_is_that_which_the_table_holds_first(spark, tmp_path):
    kind = "l_partkey bigint, l_orderkey bigint, l_linenumber int, l_extendedprice double"
    files = [[(p, 5, 1, None), (p, 5, 1, 10.0 * p), (p, 5, 1, 1.0), (p, 4, 12, 3.0), (p, None, 1, 7.0)] for p in range(1, 40)], [[(p, 5, 1, 2.0), (p, 9, 9, 0.0)] for p in range(40)]
    for rows in files:  # 4 * 10 + 12 comes after 5 * 10 + 1
        spark.createDataFrame([r for group in rows for r in group], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "lineitem.parquet"))
    names = sorted((tmp_path / "lineitem.parquet").glob("*.parquet"))
    for new, old in zip("ba", sorted(names, key=lambda n: spark.read.parquet(str(n)).count()), strict=True):  # the larger table comes first
        old.rename(old.with_name(f"{new}.parquet"))
        old.with_name(f".{old.name}.crc").unlink(missing_ok=True)
    got = {r["token"]: (r["value"], r["n"]) for r in registry.queries()["first_page_tokens"](spark, str(tmp_path)).collect()}
    assert got == {0: (2.0, 2)} | {p: (10.0 * p, 7) for p in range(1, 40)}


def test_sections_and_blocks_of_deep_and_long_pages(spark, tmp_path):
    """Bold tags that are never closed go deeper than 40 levels, more than 5,000 nodes and 20,000 characters are whole."""
    text, long = "word " * 30, "long " * 5000
    deep = "<article>" + "".join(f"<p>{text}{i}</p><p>x<b>" for i in range(60)) + "<p>end</p>"
    wide = "<article>" + "<p>x</p>" * 6000 + f"<p>{long}</p></article>"
    rows = [(3, "https://a/b", deep), (6, "https://a/c", wide), (4, "https://a/d", deep), (5, "https://a/e", None)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name in ("node_sections", "page_blocks"):
        got = registry.queries()[name](spark, str(tmp_path))
        want = con.execute(registry.oracle_sql()[name]).fetchall()
        assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) == 4


def test_runs_give_plain_rows():
    """Runs give rows, not a frame each."""

    class State(list):
        get, appendList, getListState, registerTimer = (lambda s: iter(s)), list.extend, (lambda s, *_: s), (lambda s, _: None)

    run = Runs(["view", "print"], 1000)
    run.init(State())
    assert [tuple(r) for r in run.handleInputRows((1, 0), iter([Row(profile="view"), Row(profile="x"), Row(profile="view")]), None)] == [(1, 0, "view", "captured")]
    assert [tuple(r) for r in run.handleExpiredTimer((1, 0), None, None)] == [(1, 0, "print", "skipped")]


def test_sites_of_many_sheets_keep_all_properties_and_faces(spark, tmp_path):
    """One kind of part has 400 brands, another one sheet; equal brands and sizes are one face."""
    parts = [(k, f"Brand#{k % 400}", "MANY", k % 3 + 1) for k in range(1250)] + [(1250, "Brand#1", "ONE", 7)]
    spark.createDataFrame(parts, "p_partkey bigint, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    got = registry.queries()["sheet_tokens"](spark, str(tmp_path)).select("site", "n_variables", "n_faces", "widths")
    want = con.execute(f"SELECT site, n_variables, n_faces, widths FROM ({registry.oracle_sql()['sheet_tokens']})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) == [("MANY", 401, 1200, [10, 20, 30]), ("ONE", 2, 1, [70])]
