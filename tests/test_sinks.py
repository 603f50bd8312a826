"""Trees of files that are written as a whole, and streams whose batches are taken once."""

import os

import pytest
from pyspark.sql import functions as F

from pagewright.plans.session import scratch_path
from pagewright.sources import tree
from pagewright.sources.tables import STATES
from pagewright.streaming.once import DEAD, GOOD, OnceSink

ROWS = "path string, content binary"


def beside(path):
    folder, name = os.path.split(path)
    return sorted(n for n in os.listdir(folder) if n.startswith(name))


def test_tree_round_trip(spark):
    rows = [("a/b.txt", b"one"), ("a/c d+%20é.bin", bytes(range(256))), ("top", b""), ("x/y/z/deep.txt", None)]
    root = scratch_path(spark, "tree")
    tree.write_tree(spark.createDataFrame(rows, ROWS).repartition(3), root)
    got = {r["path"]: bytes(r["content"]) for r in tree.read_tree(spark, root).collect()}
    assert got == {p: c or b"" for p, c in rows} and beside(root) == [os.path.basename(root)]
    with pytest.raises(Exception, match="already"):
        tree.write_tree(spark.createDataFrame(rows, ROWS), root)
    tree.write_tree(spark.createDataFrame([("new", "text")], "path string, content string"), root, overwrite=True)
    assert {r["path"] for r in tree.read_tree(spark, root).collect()} == {"new"} and beside(root) == [os.path.basename(root)]
    empty = scratch_path(spark, "tree")
    tree.write_tree(spark.createDataFrame([], ROWS), empty)
    assert os.listdir(empty) == []


@pytest.mark.parametrize("bad", [[("../up", b"")], [("/root", b"")], [("a//b", b"")], [("a\\b", b"")], [(None, b"")], [("a" * 300, b"")], [("A/x", b""), ("a/X", b"")], [("a", b""), ("a/b", b"")], [("a", b"1"), ("a", b"2")]])
def test_tree_of_bad_paths_leaves_nothing(spark, bad):
    root = scratch_path(spark, "tree")
    with pytest.raises(Exception):  # noqa: B017  as Spark reports a failed task, or a refused commit
        tree.write_tree(spark.createDataFrame([("fine.txt", b"x"), *bad], ROWS).repartition(3), root)
    assert beside(root) == []


def test_aborted_job_and_limits_leave_nothing(spark):
    root = scratch_path(spark, "tree")
    rows = spark.range(40).select(F.format_string("f/%s.txt", "id").alias("path"), F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise("x").alias("content"))
    with pytest.raises(Exception, match="lost"):
        tree.write_tree(rows.repartition(4), root)
    good = spark.range(40).select(F.format_string("f/%s.txt", "id").alias("path"), F.lit("xy").alias("content"))
    for limits in ({"most_files": 39}, {"most_bytes": 79}):
        with pytest.raises(Exception, match="more than"):
            tree.write_tree(good, root, **limits)
    assert beside(root) == []
    tree.write_tree(good, root, most_files=40, most_bytes=80)
    assert tree.read_tree(spark, root).count() == 40


def test_replayed_batches_change_nothing(spark):
    sink = OnceSink(spark, scratch_path(spark, "once"))
    assert sink.read() is None
    batch = spark.createDataFrame([(1, None), (2, "bad"), (3, None)], "id int, problem string")
    assert sink.write(batch, 0, F.col("problem")) and not sink.write(batch.limit(0), 0, F.col("problem"))
    assert sink.write(batch.where("id = 3"), 1, F.col("problem"))
    assert sorted((r["id"], r["batch"]) for r in sink.read(GOOD).collect()) == [(1, 0), (3, 0), (3, 1)]
    assert [(r["id"], r["reason"], r["batch"]) for r in sink.read(DEAD).collect()] == [(2, "bad", 0)]
    folder = f"{sink.log.path}/{STATES}"
    assert len([n for n in os.listdir(folder.removeprefix("file:")) if not n.startswith(".")]) == 4


def test_failed_and_second_writers_of_a_batch_leave_nothing(spark):
    sink = OnceSink(spark, scratch_path(spark, "once"))
    broken = spark.range(3).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        sink.write(broken, 0)
    assert sink.log.versions() == []
    own = sink.log.versions
    sink.write(spark.range(2), 0)
    sink.log.versions = lambda: []  # as seen by a writer that looked before the other was done
    assert not sink.write(spark.range(5), 0)
    sink.log.versions = own
    assert sink.read().count() == 2
    assert len(os.listdir(f"{sink.log.path}/{STATES}".removeprefix("file:"))) == 1
