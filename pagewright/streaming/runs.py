"""Runs of a page through its profiles, as a stream with state and timers, and as a batch.

A run is a page and a span of time.  Profiles are captured as they come; when the
watermark passes the end of a run, those that have not come are skipped, and the
run's state is given up.  Spark's time to live goes by the clock only and cannot be
had beside timers of event time, so the timer ends the state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CAPTURED, SKIPPED = "captured", "skipped"
OUT = "page bigint, start_ms bigint, profile string, status string"
#: The state store that list state and timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Runs(StatefulProcessor):
    """One run: the profiles that have come, and a timer at its end."""

    def __init__(self, profiles: Sequence[str], width_ms: int):
        self.profiles, self.width_ms = list(profiles), width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "profile string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = [p[0] for p in self.seen.get()]
        came = sorted({r["profile"] for r in rows if r["profile"] in self.profiles} - set(known))
        if not known:
            self.handle.registerTimer(key[1] + self.width_ms)
        if came or not known:
            # a run without a known profile holds an empty one, so that its timer is set once
            self.seen.appendList([(p,) for p in came] or [("",)])
        for p in came:
            yield Row(page=key[0], start_ms=key[1], profile=p, status=CAPTURED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = {p[0] for p in self.seen.get()}
        self.seen.clear()
        for p in self.profiles:
            if p not in known:
                yield Row(page=key[0], start_ms=key[1], profile=p, status=SKIPPED)

    def close(self) -> None:
        pass


def _placed(captures: DataFrame, width_ms: int) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return captures.withColumn("start_ms", ms - F.pmod(ms, F.lit(width_ms)))


def streamed_runs(captures: DataFrame, profiles: Sequence[str], width_ms: int, lateness: str = "10 minutes") -> DataFrame:
    """Rows OUT of a stream of captures (page, profile, ts), as they become known.

    The session must use PROVIDER as its state store.
    """
    marked = _placed(captures.withWatermark("ts", lateness), width_ms).select("page", "start_ms", "profile", "ts")
    return marked.groupBy("page", "start_ms").transformWithState(Runs(profiles, width_ms), OUT, "append", "EventTime")


def batch_runs(captures: DataFrame, profiles: Sequence[str], width_ms: int, late_ms: int = 600_000) -> DataFrame:
    """The same rows of a table; runs that a stream's watermark would not have passed yet have no skips."""
    placed = _placed(captures, width_ms)
    wanted = F.array(*[F.lit(p) for p in profiles])
    runs = placed.groupBy("page", "start_ms").agg(F.collect_set(F.when(F.array_contains(wanted, F.col("profile")), F.col("profile"))).alias("seen"))
    # in whole milliseconds, as the stream counts them
    ends = captures.agg((F.max(F.unix_millis(F.col("ts").cast("timestamp"))) - late_ms).alias("mark"))
    both = runs.join(F.broadcast(ends))  # one row
    done = F.col("start_ms") + width_ms <= F.col("mark")
    came = F.transform(F.array_intersect(wanted, "seen"), lambda p: F.struct(p.alias("profile"), F.lit(CAPTURED).alias("status")))
    skipped = F.when(done, F.transform(F.array_except(wanted, F.col("seen")), lambda p: F.struct(p.alias("profile"), F.lit(SKIPPED).alias("status")))).otherwise(F.array().cast("array<struct<profile:string,status:string>>"))
    return both.select("page", "start_ms", F.explode(F.concat(came, skipped)).alias("x")).select("page", "start_ms", "x.*")
