"""Every registered query against its DuckDB statement, on the smallest tables."""

import math

import duckdb
import pytest

from pagewright.plans import registry

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return float(f"{float(v):.9g}") if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, sf, name):
    got = registry.queries()[name](spark, sf)
    rows = got.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows and len(set(got.columns)) == len(got.columns)
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(repr(tuple(map(plain, r))) for r in result.fetchall())
    assert sorted(repr(tuple(plain(r[n]) for n in names)) for r in rows) == want
