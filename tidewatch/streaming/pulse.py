"""The pulse map as a stream: what was shown stays hidden for the retention time, then its state lapses."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.functions import fixed as K

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "pulse_key string, ts timestamp, branch string"


def use_state_store(spark: SparkSession) -> None:
    """State with timers lives in RocksDB, on the executors' disks and in the checkpoint, so it isn't bounded by memory."""
    spark.conf.set(STORE, ROCKS)


class ShownPulses(StatefulProcessor):
    """One number a key: when it was last shown. A timer drops it when the watermark says that it hides nothing any more."""

    def __init__(self, retention_ms: int):
        self.retention_ms = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shown = handle.getValueState("shown", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = int(self.shown.get()[0]) if self.shown.exists() else None
        before, out = last, []
        # a key's few rows of a batch, by time
        for at in sorted(t for pdf in rows for t in pdf["ts"]):
            ms = at.value // 1_000_000
            show = last is None or ms - last > self.retention_ms
            if show:
                last = ms
            out.append((key[0], at, "SHOW" if show else "HIDE"))
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.retention_ms + 1)
            self.shown.update((last,))
            self.handle.registerTimer(last + self.retention_ms + 1)
        yield pd.DataFrame(out, columns=["pulse_key", "ts", "branch"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.shown.clear()
        yield pd.DataFrame({"pulse_key": pd.Series(dtype=str), "ts": pd.Series(dtype="datetime64[ns]"), "branch": pd.Series(dtype=str)})

    def close(self) -> None:
        pass


def pulse_branches(items: DataFrame, days: float = K.PULSE_RETENTION_DAYS, delay: str = "5 minutes") -> DataFrame:
    """(pulse_key, ts, branch) of a stream of (pulse_key, ts): SHOW unless the key was shown within `days` before, to the instant inclusive; else HIDE.

    Hidden rows don't renew the time. Rows of a null key or time go nowhere; rows of a batch are taken by time, those later than the
    watermark allows are dropped by Spark.
    """
    timed = items.filter("pulse_key IS NOT NULL AND ts IS NOT NULL").select("pulse_key", "ts").withWatermark("ts", delay)
    return timed.groupBy("pulse_key").transformWithStateInPandas(ShownPulses(int(days * 86_400_000)), OUT, "append", "eventTime")
