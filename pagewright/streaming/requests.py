"""Requests to workers and their replies, with time limits: as a batch, and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTCOME = "id string, outcome string, asked timestamp, replied timestamp"
_KEPT = "asked timestamp"


def outcomes(messages: DataFrame, limit: str = "5 minutes", now=None) -> DataFrame:
    """What became of each request in rows (id, ts, kind: ask or reply): answered, timed_out, pending or unasked.

    The first reply counts; one that comes after ``limit`` is too late.  ``now`` (a
    column; the latest time of all messages if not given) tells what still may come.
    """
    sums = messages.groupBy("id").agg(F.min(F.when(F.col("kind") == "ask", F.col("ts"))).alias("asked"), F.min(F.when(F.col("kind") == "reply", F.col("ts"))).alias("replied"))
    if now is None:
        sums = sums.join(F.broadcast(messages.agg(F.max("ts").alias("now"))))  # one row
    else:
        sums = sums.withColumn("now", now)
    until = F.col("asked") + F.expr(f"INTERVAL {limit}")
    outcome = F.when(F.col("asked").isNull(), "unasked").when(F.col("replied") <= until, "answered").when(F.col("replied").isNotNull() | (F.col("now") > until), "timed_out").otherwise("pending")
    return sums.select("id", outcome.alias("outcome"), "asked", F.when(outcome == "answered", F.col("replied")).alias("replied"))


def track(messages: DataFrame, limit: str = "5 minutes", lateness: str = "1 minute") -> DataFrame:
    """The same over a stream: a row as soon as a request is answered, or its time has passed by the watermark.

    State is one time per open request and goes when the request is closed.
    """
    seconds = pd.Timedelta(limit)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        asked = pd.Timestamp(state.get[0]) if state.exists else None
        row = lambda outcome, replied=None: pd.DataFrame({"id": [key[0]], "outcome": [outcome], "asked": [asked], "replied": [replied]})
        if state.hasTimedOut:
            state.remove()
            yield row("timed_out")
            return
        rows = pd.concat(list(batches)).sort_values("ts")
        asks = rows.loc[rows["kind"] == "ask", "ts"]
        if asked is None and len(asks):
            asked = asks.iloc[0]
        replies = rows.loc[rows["kind"] == "reply", "ts"]
        if asked is None:
            return
        if len(replies):
            if state.exists:
                state.remove()
            first = replies.iloc[0]
            yield row("answered", first) if first <= asked + seconds else row("timed_out")
            return
        state.update((asked.to_pydatetime(),))
        state.setTimeoutTimestamp(max(int((asked + seconds).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))

    marked = messages.withWatermark("ts", lateness)
    return marked.groupBy("id").applyInPandasWithState(step, OUTCOME, _KEPT, "append", GroupStateTimeout.EventTimeTimeout)
