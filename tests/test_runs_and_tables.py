"""Crawl runs against a sequential one; transactions of tables with several writers."""

import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import crawl
from pagewright.plans.session import scratch_path
from pagewright.sources import files, tables


@pytest.mark.parametrize("seed", range(4))
def test_run_equals_sequential(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60), i, rng.random() < 0.9) for i in range(260)]
    attempts = {}
    for key in range(60):
        n = rng.choice([0, 0, 0, 1, 2, 5])
        attempts |= {(key, i): "retryable" for i in range(n)}
        if rng.random() < 0.5:
            attempts[key, n] = rng.choice(["loaded", "failed", "auth_required", *(["fatal"] if seed == 3 else [])])
    made = spark.createDataFrame(links, "source int, target int, seq int, in_scope boolean"), spark.createDataFrame([(0,), (7,), (0,)], "key int"), spark.createDataFrame([(*k, o) for k, o in attempts.items()], "key int, attempt int, outcome string")
    limits = [(3, 40, 5, 2), (2, 25, 50, 3), (4, 60, 1, 0), (3, 60, 9, 1)][seed]
    got = sorted(tuple(r) for r in crawl.crawl_run(*made, *limits).collect())
    assert got == plain_run(links, attempts, limits)
    result = crawl.run_result(spark.createDataFrame(got, "key int, depth int, place int, status string, attempts int"), limits[2]).first()
    failed = sum(r[3] == "failed" for r in got)
    assert (result["discovered"], result["failed"], result["status"]) == (len(got), failed, "failed" if failed >= limits[2] or any(r[3] == "fatal" for r in got) else "completed")


def plain_run(links, attempts, limits):
    """One page after another, as a single worker would, with the links of a page in the order of seq."""
    own = {}
    for a, _, b, fits in sorted((a, i, b, fits) for a, b, i, fits in links):
        own.setdefault(a, []).append((b, fits))
    max_depth, max_pages, max_failures, max_retries = limits
    queue, seen, out, failures, stopped = [(k, 0) for k in sorted({0, 7})[:max_pages]], {0, 7}, [], 0, False
    for at, (key, depth) in enumerate(queue, 1):
        if stopped:
            out.append((key, depth, at, "queued", 0))
            continue
        tries = next(i for i in range(99) if attempts.get((key, i), "loaded") != "retryable" or i == max_retries)
        outcome = attempts.get((key, tries), "loaded")
        outcome = "failed" if outcome == "retryable" else outcome
        out.append((key, depth, at, outcome, tries + 1))
        failures += outcome == "failed"
        stopped = outcome == "fatal" or (outcome == "failed" and failures >= max_failures)
        for b, fits in own.get(key, []) if outcome == "loaded" and depth < max_depth else []:
            if fits and b not in seen and len(seen) < max_pages:
                seen.add(b)
                queue.append((b, depth + 1))
    return sorted(out)


def test_run_of_nothing(spark):
    links = spark.createDataFrame([], "source int, target int, seq int, in_scope boolean")
    seeds, attempts = spark.createDataFrame([], "key int"), spark.createDataFrame([], "key int, attempt int, outcome string")
    assert crawl.crawl_run(links, seeds, attempts).count() == 0
    assert crawl.run_result(crawl.crawl_run(links, seeds, attempts)).first()["status"] == "completed"


def test_two_writers_of_one_table(spark):
    log = tables.TableLog(spark, scratch_path(spark, "log"))
    assert log.latest() == 0 and log.versions() == []
    log.replace("t", spark.range(3))
    one, two = log.begin(), log.begin()
    one.write("t", one.read("t").where("id <> 0"))
    two.write("t", two.read("t").where("id <> 1"))
    assert log.read("t").count() == 3  # nothing shows before the commit
    assert one.commit() == 2
    with pytest.raises(tables.Conflict, match="'t'"):
        two.commit()
    assert sorted(r["id"] for r in log.read("t").collect()) == [1, 2] and two.staged == {}
    assert log.update("t", lambda t: t.where("id <> 1")) == 3  # based on what is there now
    assert [r["id"] for r in log.read("t").collect()] == [2]
    assert log.read("t", 1).count() == 3
    with pytest.raises(KeyError):
        log.read("none")


def test_update_is_done_again_after_another_writer(spark):
    log = tables.TableLog(spark, scratch_path(spark, "log"))
    log.replace("t", spark.range(4))
    calls = []

    def change(t):
        if not calls:
            log.replace("t", spark.range(2, 8))  # another writer, in between
        calls.append(t.count())
        return t.where("id % 2 = 0")

    log.update("t", change)
    assert calls == [4, 6] and sorted(r["id"] for r in log.read("t").collect()) == [2, 4, 6]
    with pytest.raises(tables.Conflict):
        log.update("t", lambda t: log.replace("t", t) and t, tries=2)


def test_transactions_over_several_tables(spark):
    log = tables.TableLog(spark, scratch_path(spark, "log"))
    with log.begin() as tx:
        tx.write("a", spark.range(2))
        tx.write("b", spark.range(3))
        assert tx.read("a").count() == 2
    with pytest.raises(ZeroDivisionError), log.begin() as tx:
        tx.write("a", spark.range(9))
        1 / 0  # noqa: B018
    assert (log.read("a").count(), log.latest()) == (2, 1)
    one, two = log.begin(), log.begin()
    one.write("a", spark.range(5))
    two.write("b", two.read("b").limit(1))  # touches another table: both may be committed
    one.commit()
    two.commit()
    assert (log.read("a").count(), log.read("b").count(), log.latest()) == (5, 1, 3)
    reader = log.begin()
    reader.write("c", reader.read("a"))
    log.replace("a", spark.range(1))
    with pytest.raises(tables.Conflict):  # what it has read is no longer so
        reader.commit()
    with log.begin() as tx:
        tx.remove("b")
    assert set(log.states(log.latest())) == {"a"}
    lost = log.begin()
    lost.write("x", spark.range(1))  # never committed
    gone = log.vacuum()
    assert len(log.versions()) == 1 and log.read("a").count() == 1 and not any(g.startswith("x-") for g in gone) and len(gone) == 4
    assert [g.startswith("x-") for g in log.vacuum(older_ms=0)] == [True]


def test_replacing_with_a_base(spark):
    path = scratch_path(spark, "based")
    files.replace_table(spark.range(3), path)
    base = tables.TableLog(spark, path).latest()
    seen = files.read_table(spark, path)
    files.replace_table(seen.where("id <> 0"), path, base)
    with pytest.raises(tables.Conflict):
        files.replace_table(seen.where("id <> 1"), path, base)
    assert sorted(r["id"] for r in files.read_table(spark, path).select(F.col("id")).collect()) == [1, 2]
