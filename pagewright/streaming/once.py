"""A sink of streams that takes each batch once, and sets malformed rows aside."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.plans.session import remove_path
from pagewright.sources.tables import STATES, TableLog

#: What a batch leaves: rows that are well formed, and those that are not.
GOOD, DEAD = "good", "dead"


class OnceSink:
    """The batches of a stream below ``path``, each as one version of a log.

    Spark hands a batch over again after a failure; a batch whose version is there
    is passed over, and of two writers of one batch the second takes its files away.
    Readers see a batch as a whole or not at all.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.log = TableLog(spark, path)

    def writer(self, problem: Column | None = None) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``; rows for which ``problem`` is not null are dead letters, with it as their reason."""
        return lambda batch, number: self.write(batch, number, problem)

    def write(self, batch: DataFrame, number: int, problem: Column | None = None) -> bool:
        """Writes one batch; False if it had been written before."""
        version = number + 1
        if version in self.log.versions():
            return False
        parts = {GOOD: batch} if problem is None else {GOOD: batch.where(problem.isNull()), DEAD: batch.where(problem.isNotNull()).withColumn("reason", problem)}
        if problem is not None:
            batch.persist()
        staged = {name: f"{name}-{version}-{uuid.uuid4().hex}" for name in parts}
        try:
            for name, part in parts.items():
                part.write.parquet(f"{self.log.path}/{STATES}/{staged[name]}")
            done = self.log.put(version, staged)
        except Exception:
            self._drop(staged)
            raise
        finally:
            if problem is not None:
                batch.unpersist()
        if not done:
            self._drop(staged)
        return done

    def _drop(self, staged: dict[str, str]) -> None:
        for state in staged.values():
            remove_path(self.log.spark, f"{self.log.path}/{STATES}/{state}")

    def read(self, name: str = GOOD) -> DataFrame | None:
        """All rows of the batches so far, with ``batch``; None before the first."""
        spark, found = self.log.spark, []
        for version in self.log.versions():
            states = self.log.states(version)
            if name in states:
                found.append((f"{self.log.path}/{STATES}/{states[name]}", version - 1))
        if not found:
            return None
        rows = spark.read.parquet(*[path for path, _ in found])
        number = F.regexp_extract(F.input_file_name(), rf"/{name}-(\d+)-[0-9a-f]+/", 1).cast("int") - 1
        return rows.withColumn("batch", number)
