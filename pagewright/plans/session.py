"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``.  Only where that is unset and
    all of Spark runs on one machine, a temporary folder takes its place.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if named:
        folder = named
    elif current.isDefined():
        return current.get()
    elif not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    else:
        folder = tempfile.mkdtemp(prefix="pagewright-")
    if not current.isDefined():
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, and read from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a fresh path in the shared folder as Parquet, and read from there.

    Other than a checkpoint it is compressed, and readers take the columns they need.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    _MADE.append(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Removes ``path``, which may be on any file system that Spark knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch paths that are made inside, once what needs them has been written."""
    before = len(_MADE)
    yield
    for path in _MADE[before:]:
        remove_path(spark, path)
    del _MADE[before:]
