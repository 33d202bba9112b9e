"""Memory of hosts as stream state: blocks with a time to live, and a circuit breaker, both forgotten when a host is idle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

POLICY = "host string, ts timestamp, blocks long, browser_until timestamp, open_until timestamp"
_STATE = "seen double, last double, blocks long, until double, run long, opened double"
_NEW = (0.0, 0.0, 0, 0.0, 0, 0.0)


class _Policies(StatefulProcessor):
    def __init__(self, ttl: int, threshold: int, failures: int, cooldown: int, keep: int):
        self.limits = ttl, threshold, failures, cooldown, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ttl, threshold, failures, cooldown, keep = self.limits
        seen, last, blocks, until, run, opened = self.memory.get() if self.memory.exists() else _NEW
        out = []
        for ts, outcome in pd.concat(list(rows)).sort_values(["ts", "outcome"])[["ts", "outcome"]].itertuples(index=False):
            now = ts.timestamp()
            if now - seen > keep:  # as when the timer has fired in between
                _, last, blocks, until, run, opened = _NEW
            seen = max(seen, now)
            if outcome == "blocked":
                blocks = 1 if now - last > ttl else blocks + 1
                last = now
                if blocks >= threshold:
                    until = now + ttl
            elif outcome == "ok":
                blocks, until, run = 0, 0.0, 0
            elif outcome == "failed":
                run += 1
                if run >= failures:
                    opened, run = now + cooldown, 0
            stamp = lambda x, n=now: pd.Timestamp(round(x * 1_000_000), unit="us") if x > n else pd.NaT
            out.append((key[0], ts, blocks, stamp(until), stamp(opened)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((seen + keep) * 1000) + 1)
        self.memory.update((seen, last, int(blocks), until, int(run), opened))
        yield pd.DataFrame(out, columns=["host", "ts", "blocks", "browser_until", "open_until"]).astype({"browser_until": "datetime64[ns]", "open_until": "datetime64[ns]"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.memory.clear()
        yield from ()


def policies(fetches: DataFrame, ttl_seconds: int = 3600, threshold: int = 2, failures: int = 5, cooldown_seconds: int = 300, keep_seconds: int = 86_400, late: str = "1 hour") -> DataFrame:
    """A row for each fetch (host, ts, outcome: ok, blocked or failed) with the host's policy after it.

    A block counts on from the last one unless that is older than the time to live; at the threshold the browser is used
    until ts + ttl; a success cancels that. Failures in a row open the circuit once for the cooldown; a success closes the
    count. A host without fetches for keep_seconds is forgotten: a timer on the stream's time drops its state, and a fetch
    after such a gap begins anew even where both sides of the gap come in one batch, so that results do not depend on how
    fetches fall into batches. Fetches are taken in order of time within a batch, outcomes in order of name at one time;
    those later than the watermark are dropped. State is a few numbers a host, in RocksDB."""
    fetches.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    processor = _Policies(ttl_seconds, threshold, failures, cooldown_seconds, keep_seconds)
    return fetches.withWatermark("ts", late).groupBy("host").transformWithStateInPandas(processor, POLICY, "append", "EventTime")
