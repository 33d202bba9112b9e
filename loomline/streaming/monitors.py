"""Monitors as streams: changes by key with state, and windowed rates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "user_id long, event_id long, old_value string, new_value string, unchanged long"


def changes(events: DataFrame, key: str = "user_id", value: str = "event_type", forget_seconds: int | None = None, late: str = "1 hour") -> DataFrame:
    """A row for each event whose value differs from the key's last one (or is its first), with how many events in a row
    had not changed. Events are taken in order of time within a batch.

    State: last value and that count, a row a key. With forget_seconds, a key without events for so long is forgotten: its
    next event is its first, and its state goes when the stream's time has passed; events later than the watermark are
    dropped then. Without it, all keys are remembered."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, streak, seen = state.get if state.exists else (None, 0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event, ts, now in zip(rows["event_id"], rows["ts"], rows[value], strict=True):
            if forget_seconds is not None and ts.timestamp() - seen > forget_seconds:
                last, streak = None, 0
            seen = max(seen, ts.timestamp())
            if now == last:
                streak += 1
            else:
                out.append((group[0], event, last, now, streak))
                last, streak = now, 0
        state.update((last, int(streak), seen))
        if forget_seconds is not None:
            state.setTimeoutTimestamp(max(int((seen + forget_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "old_value", "new_value", "unchanged"])

    timeout = GroupStateTimeout.NoTimeout if forget_seconds is None else GroupStateTimeout.EventTimeTimeout
    events = events if forget_seconds is None else events.withWatermark("ts", late)
    return events.groupBy(key).applyInPandasWithState(step, CHANGES, "last string, streak long, seen double", "append", timeout)


def rates(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events and failures of each window and type; the watermark bounds the state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failures"))
