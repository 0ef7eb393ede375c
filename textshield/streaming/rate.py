"""Fixed windows that open with a key's first event, in batch and as a stream.

A window lasts ``seconds`` from the event that opened it; an event at or after
its end opens the next.  Which event opens a window depends on the one before,
so a key's events are folded in order, in a stream of sorted rows with one
window held at a time: memory doesn't grow with a key's events.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_FOLDED = "key string, us long, count long, end_us long, allowed boolean"


def _fold(pdf: pd.DataFrame, key, end, count, limit: int, width: int) -> tuple[pd.DataFrame, object, object, int]:
    """Windows of sorted rows; key, end and count are those of the window still open."""
    keys, times = pdf["key"].to_numpy(), pdf["us"].to_numpy()
    counts, ends = np.empty(len(times), np.int64), np.empty(len(times), np.int64)
    cuts = [*np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)] if len(keys) else []
    at = 0
    for stop in cuts:
        own = times[at:stop]
        if keys[at] != key:
            key, end, count = keys[at], None, 0
        i = 0
        while i < len(own):
            if end is None or own[i] >= end:
                end, count = int(own[i]) + width, 0
            j = int(np.searchsorted(own, end, "left"))
            counts[at + i : at + j] = np.arange(count + 1, count + 1 + j - i)
            ends[at + i : at + j] = end
            count, i = count + j - i, j
        at = stop
    return pd.DataFrame({"key": keys, "us": times, "count": counts, "end_us": ends, "allowed": counts <= limit}), key, end, count


def _timed(events: DataFrame, key_col: str, ts_col: str) -> DataFrame:
    rows = events.select(F.col(key_col).cast("string").alias("key"), F.col(ts_col).cast("timestamp").alias("ts"))
    return rows.where("key IS NOT NULL AND ts IS NOT NULL")


def _shown(folded: DataFrame) -> DataFrame:
    return folded.select("key", F.timestamp_micros("us").alias("ts"), "count", F.timestamp_micros("end_us").alias("expire_at"), "allowed")


def rate_windows(events: DataFrame, key_col: str = "key", ts_col: str = "ts", seconds: int = 60, limit: int = 20) -> DataFrame:
    """(key, ts, count, expire_at, allowed) of every event with a key and a time."""
    width = seconds * 1_000_000
    rows = _timed(events, key_col, ts_col).select("key", F.unix_micros("ts").alias("us"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, end, count = None, None, 0
        for pdf in batches:
            out, key, end, count = _fold(pdf, key, end, count, limit, width)
            yield out

    return _shown(rows.repartition("key").sortWithinPartitions("key", "us").mapInPandas(run, _FOLDED))


def rejected(windows: DataFrame) -> DataFrame:
    """Events over the limit, with the whole seconds to wait until their window ends."""
    wait = F.greatest(F.lit(0), F.floor((F.unix_micros("expire_at") - F.unix_micros("ts")) / 1_000_000)).cast("long")
    return windows.where(~F.col("allowed")).select("key", "ts", "count", wait.alias("retry_after"))


def rate_stream(events: DataFrame, key_col: str = "key", ts_col: str = "ts", seconds: int = 60, limit: int = 20, lateness: str = "1 hour") -> DataFrame:
    """The same on a stream: one window of state for each key, dropped when it ends.

    A window ends in the events' own time, once the watermark, ``lateness``
    behind the latest event, has passed it; so a replay counts as the live
    stream did.  Events of a micro-batch are taken in order of time; one that
    comes in a later batch than its successors counts in the window then open,
    and one behind the watermark is dropped.
    """
    width = seconds * 1_000_000
    rows = _timed(events, key_col, ts_col).withWatermark("ts", lateness).withColumn("us", F.unix_micros("ts"))

    def run(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        end, count = state.get if state.exists else (None, 0)
        # a key's rows of one micro-batch
        pdf = pd.concat(list(pdfs)).sort_values("us")
        out, _, end, count = _fold(pdf, key[0], end, count, limit, width)
        state.update((end, count))
        state.setTimeoutTimestamp(-(-end // 1000))
        yield out

    return _shown(rows.groupBy("key").applyInPandasWithState(run, _FOLDED, "end_us long, count long", "append", "EventTimeTimeout"))


class _Window(StatefulProcessor):
    """A key's open window as one value: its end and how many events it has had."""

    def __init__(self, seconds: int, limit: int, ttl_ms: int | None, late: str):
        self.width, self.limit, self.ttl_ms, self.late = seconds * 1_000_000, limit, ttl_ms, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "end_us long, count long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        end, count = self.window.get() if self.window.exists() else (None, 0)
        pdf = pd.concat(list(rows)).sort_values("us")  # a key's rows of one micro-batch
        if self.late == "reject" and end is not None:
            # before the open window began: no longer counted, and not allowed
            early = pdf["us"] < end - self.width
            if early.any():
                gone = pdf.loc[early, ["key", "us"]]
                yield gone.assign(count=0, end_us=end - self.width, allowed=False)
                pdf = pdf.loc[~early]
        if len(pdf):
            out, _, end, count = _fold(pdf, key[0], end, count, self.limit, self.width)
            self.window.update((end, count))
            if self.ttl_ms is None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
                self.handle.registerTimer(-(-end // 1000))
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.window.clear()
        yield pd.DataFrame({"key": [], "us": [], "count": [], "end_us": [], "allowed": []}).astype({"us": "int64", "count": "int64", "end_us": "int64", "allowed": bool})

    def close(self) -> None:
        pass


def rate_state(events: DataFrame, key_col: str = "key", ts_col: str = "ts", seconds: int = 60, limit: int = 20, lateness: str | None = "1 hour", ttl_seconds: int | None = None, late: str = "count") -> DataFrame:
    """``rate_stream`` on value state that lapses by itself.

    With ``ttl_seconds`` a key's state is dropped that long after its last
    event by the clock of the machine, as a store with expiring rows does it; no
    watermark is needed, but batches without data should be off
    (``spark.sql.streaming.noDataMicroBatches.enabled``) where a run is to end
    with its input.  Without, a timer drops it when the watermark,
    ``lateness`` behind the latest event, has passed the window's end.

    ``late`` says what becomes of an event of a later micro-batch that is older
    than the open window: ``count`` counts it in that window, ``reject`` turns
    it down with a count of 0.  The session needs RocksDB as its state store.
    """
    if late not in ("count", "reject"):
        raise ValueError("late must be count or reject")
    rows = _timed(events, key_col, ts_col)
    if ttl_seconds is None:
        rows = rows.withWatermark("ts", lateness or "0 seconds")
    rows = rows.withColumn("us", F.unix_micros("ts"))
    processor = _Window(seconds, limit, None if ttl_seconds is None else ttl_seconds * 1000, late)
    mode = "EventTime" if ttl_seconds is None else "ProcessingTime"
    return _shown(rows.groupBy("key").transformWithStateInPandas(processor, _FOLDED, "Append", mode))
