"""The daily run as streams: late items, repeats, running ledger state and idempotent writes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.operators import dedup

OVERLAP = "5 minutes"


def read_events(spark: SparkSession, folder: str, schema: str, files: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def deduplicated(events: DataFrame, key: str, ts: str = "ts", delay: str = OVERLAP) -> DataFrame:
    """Each key once within the overlap of two runs; state older than that is dropped."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, width: str, ts: str = "ts", delay: str = OVERLAP) -> DataFrame:
    """Event counts in tumbling windows by type, late ones up to `delay` included (an extension)."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, width), "event_type").agg(F.count("*").alias("n"))


def resurfacing(cards: DataFrame, jump: float = 15.0, ttl_ms: int = 14 * 86_400_000, delay: str = OVERLAP) -> DataFrame:
    """(canonical_key, branch, score) for a stream of (canonical_key, score, ts): the first is NEW, a jump RESURFACEs, the rest SUPPRESS.

    One small state for each key; it lapses when the stream's time has moved on by the retention time since the key's last card.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, seen = state.get if state.exists else (None, 0)
        rows = []
        # a key's few cards of a batch, by time: they come in the order in which they were shuffled
        for ts, score in sorted((ts, score) for pdf in frames for ts, score in zip(pdf["ts"], pdf["score"])):
            branch = "NEW" if last is None else "RESURFACE" if abs(score - last) >= jump else "SUPPRESS"
            rows.append((key[0], branch, score))
            last = last if branch == "SUPPRESS" else float(score)
            seen = max(seen, int(ts.timestamp() * 1000))
        state.update((last, seen))
        state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + ttl_ms)
        yield pd.DataFrame(rows, columns=["canonical_key", "branch", "score"])

    timed = cards.withWatermark("ts", delay).groupBy("canonical_key")
    return timed.applyInPandasWithState(step, "canonical_key string, branch string, score double", "last double, seen long", "append", GroupStateTimeout.EventTimeTimeout)


def ledger_writer(path: str):
    """foreachBatch function that merges a micro-batch into the ledger; a batch that is replayed changes nothing.

    Versions are folders by batch number. A batch reads the latest version before its own and writes its own anew,
    so a crash between the write and the commit is repaired by the replay.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
        done = sorted(int(s.getPath().getName()[2:]) for s in (fs.listStatus(fs_path) if fs.exists(fs_path) else ()) if s.getPath().getName().startswith("v="))
        before = [v for v in done if v < number]
        old = spark.read.parquet(f"{path}/v={before[-1]}").select(batch.columns) if before else batch.limit(0)
        dedup.upsert(old, batch).select(batch.columns).write.mode("overwrite").parquet(f"{path}/v={number}")

    return write


def run_available(stream: DataFrame, write, checkpoint: str) -> None:
    """Everything that is there now, in micro-batches, then stop: catching up after missed days is the same call."""
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start()
    query.awaitTermination()
