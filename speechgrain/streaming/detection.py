"""Detection of activity from polls, debounced: so many positive polls in a row switch on, so many negative ones off.

State is one value a session and timers in event time; nothing else is kept. A batch's polls apply by time, then by number.
Polls that are older than the last one applied are passed over, and those older than the watermark never arrive.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

ON_AFTER, OFF_AFTER = 3, 2
STATE = StructType([StructField("active", BooleanType()), StructField("run", LongType()), StructField("at_ms", LongType()), StructField("poll_id", LongType()), StructField("timer_ms", LongType())])
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stepped(active: bool, run: int, positive: bool, on_after: int, off_after: int) -> tuple[bool, int, bool]:
    """(active, run, switched) after a poll; ``run`` counts polls alike in a row, positive ones above zero, negative ones below."""
    run = (max(run, 0) + 1) if positive else (min(run, 0) - 1)
    now = True if run >= on_after else False if -run >= off_after else active
    return now, run, now != active


class Debounce(StatefulProcessor):
    """Emits ``(session_id, at_ms, active, timed_out)`` when a session switches; silence of ``silence_ms`` (if any) switches off."""

    def __init__(self, on_after: int = ON_AFTER, off_after: int = OFF_AFTER, silence_ms: int | None = None):
        self.on_after, self.off_after, self.silence_ms = on_after, off_after, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)

    def _rows(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=["session_id", "at_ms", "active", "timed_out"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        active, run, at, number, timer = self.state.get() if self.state.exists() else (False, 0, -(1 << 62), -1, None)
        polls = pd.concat(list(rows)).sort_values(["at", "poll_id"], kind="stable")
        out = []
        for when, poll, positive in zip(polls["at"], polls["poll_id"].tolist(), polls["positive"].tolist(), strict=True):
            ms = int(when.value // 1_000_000)
            if (ms, poll) <= (at, number):
                continue
            at, number = ms, poll
            active, run, switched = stepped(active, run, bool(positive), self.on_after, self.off_after)
            if switched:
                out.append((key[0], ms, active, False))
        if self.silence_ms is not None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = max(at + self.silence_ms, timerValues.getCurrentWatermarkInMs() + 1) if active else None
            if timer is not None:
                self.handle.registerTimer(timer)
        self.state.update((active, run, at, number, timer))
        yield from self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        active, _, at, number, timer = self.state.get()
        due = expiredTimerInfo.getExpiryTimeInMs()
        if active and timer == due:
            self.state.update((False, 0, at, number, None))
            yield from self._rows([(key[0], due, False, True)])

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession):
    """State in RocksDB, which value state with timers needs, for the queries that are started inside."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before is not None else spark.conf.unset(STORE)


def debounce(polls: DataFrame, on_after: int = ON_AFTER, off_after: int = OFF_AFTER, silence_ms: int | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Switches of ``polls(session_id, poll_id, at timestamp, positive)``, a stream; start it within ``rocks(spark)``."""
    keyed = polls.withWatermark("at", lateness).groupBy("session_id")
    kind = dict(polls.dtypes)["session_id"]
    return keyed.transformWithStateInPandas(Debounce(on_after, off_after, silence_ms), f"session_id {kind}, at_ms long, active boolean, timed_out boolean", "Append", "EventTime")
