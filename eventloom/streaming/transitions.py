"""Transitions from a stream of events, with the last state of each actor as state.

Events of an actor inside a micro-batch are ordered by time; an event before the actor's
last one comes too late to be paired and is left out, as its pairs have been emitted. The
watermark bounds how long an actor is remembered: after `gap` without an event the next one
opens a session anyway, so its state can go.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PAIRS = "actor string, from string, to string, at timestamp"


def transition_stream(events: DataFrame, actor: str, time: str, state: str, gap_seconds: int = 900, delay: str = "1 hour") -> DataFrame:
    """Pairs of consecutive states of each actor's sessions, as they become known."""
    rows = events.select(F.col(actor).cast("string").alias("actor"), F.col(time).cast("timestamp").alias("at"), F.col(state).cast("string").alias("state")).where("state IS NOT NULL").withWatermark("at", delay)

    def step(key: tuple, batches: Iterator[pd.DataFrame], last: GroupState) -> Iterator[pd.DataFrame]:
        if last.hasTimedOut:
            last.remove()
            return
        before, before_at = last.get if last.exists else (None, None)
        found = []
        for r in pd.concat(list(batches)).sort_values(["at", "state"]).itertuples():
            micros = r.at.value // 1000
            if before_at is not None and micros < before_at:
                continue
            if before is not None and micros - before_at <= gap_seconds * 1_000_000:
                found.append((key[0], before, r.state, r.at))
            before, before_at = r.state, micros
        last.update((before, before_at))
        last.setTimeoutTimestamp(max(before_at // 1000 + gap_seconds * 1000, last.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(found, columns=["actor", "from", "to", "at"])

    return rows.groupBy("actor").applyInPandasWithState(step, PAIRS, "state string, at long", "append", GroupStateTimeout.EventTimeTimeout)


def transition_counts(pairs: DataFrame) -> DataFrame:
    """Counts of what transition_stream() has written: of a table, or in foreachBatch. They
    can't follow in the same stream, as a pair may be older than the watermark by then."""
    return pairs.groupBy("from", "to").agg(F.count(F.lit(1)).alias("count"))


def windowed_counts(events: DataFrame, time: str, state: str, width: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts of states in event-time windows, late events dropped by the watermark."""
    rows = events.withWatermark(time, delay)
    return rows.groupBy(F.window(time, width, slide or width), F.col(state).alias("state")).agg(F.count(F.lit(1)).alias("count"))
