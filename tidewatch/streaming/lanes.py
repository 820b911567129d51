"""Runs of several lanes: each writes its own sink and outcome, and the watermark moves only if none failed.

The marker of a run and the new watermark are one commit. A run that fails or crashes before it leaves the watermark where it was; the next
run reads from there again, and what lanes had written for the run is overwritten, so nothing is lost and nothing counts twice.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.streaming.keyvalue import StateTable

WATERMARK = "watermark"
OVERLAP = dt.timedelta(minutes=5)


def _text(t: dt.datetime) -> str:
    return t.astimezone(dt.timezone.utc).isoformat()


class LaneRuns:
    """Runs in a folder: `state` holds watermark and outcomes, `lanes/<lane>/run=<id>` what a lane wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.state = spark, path, StateTable(spark, f"{path}/state")

    def watermark(self) -> dt.datetime | None:
        at = self.state.get(WATERMARK)
        return dt.datetime.fromisoformat(at) if at else None

    def since(self) -> dt.datetime | None:
        """Where a run reads from: the watermark less an overlap; None at first."""
        at = self.watermark()
        return at - OVERLAP if at else None

    def run(self, run_id: str, now: dt.datetime, lanes: dict[str, Callable[[dt.datetime | None], DataFrame]]) -> dict[str, str]:
        """Runs all lanes and returns their outcomes, 'ok' or the error; a lane's failure doesn't stop the others.

        A run that has its marker does nothing: what it answers is what it answered then. The watermark never goes back.
        """
        done = self.state.get(f"run:{run_id}")
        if done:
            return done
        since, outcomes = self.since(), {}
        for name, lane in sorted(lanes.items()):
            try:
                lane(since).write.mode("overwrite").parquet(f"{self.path}/lanes/{name}/run={run_id}")
                outcomes[name] = "ok"
            except Exception as e:
                outcomes[name] = f"{type(e).__name__}: {e}"[:200]
        self._commit(run_id, now, outcomes)
        return outcomes

    def _commit(self, run_id: str, now: dt.datetime, outcomes: dict[str, str]) -> None:
        clean = all(v == "ok" for v in outcomes.values())

        def change(values: dict) -> dict:
            if not clean:
                return values | {f"failed:{run_id}": outcomes}
            values = {k: v for k, v in values.items() if k != f"failed:{run_id}"}
            return values | {f"run:{run_id}": outcomes, WATERMARK: max(_text(now), values.get(WATERMARK, ""))}

        self.state.update(change)

    def table(self, lane: str) -> DataFrame | None:
        """What a lane wrote in runs that have their marker; what a failed or crashed run left is not seen. None before the first."""
        runs = [k[4:] for k in self.state.snapshot()[1] if k.startswith("run:")]
        if not runs:
            return None
        return self.spark.read.option("basePath", f"{self.path}/lanes/{lane}").parquet(*[f"{self.path}/lanes/{lane}/run={r}" for r in sorted(runs)])


def lateness(ts: Column, last_run: Column | dt.datetime | None) -> Column:
    """'late' for what was made before the last run, else 'on_time'; an unknown time, or no last run, is on time."""
    if last_run is None:
        return F.lit("on_time")
    bar = F.lit(last_run) if isinstance(last_run, dt.datetime) else last_run
    return F.when(ts < bar, "late").otherwise("on_time")


def split_late(batch: DataFrame, last_run: Column | dt.datetime | None, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(rows on time, late rows)."""
    marked = batch.withColumn("__when", lateness(F.col(ts), last_run))
    return tuple(marked.filter(F.col("__when") == w).drop("__when") for w in ("on_time", "late"))


def late_writer(runs: LaneRuns, path: str, ts: str = "ts"):
    """foreachBatch function: rows on time go to `path`/on_time, late ones to `path`/late, each by batch, and counts to the state.

    Late is what lies before the watermark that stood when the batch was first seen: it is kept with the batch's number, so
    that a batch which is replayed after a crash is split the same way.
    """

    def write(batch: DataFrame, number: int) -> None:
        key = f"batch:{number}"
        values = runs.state.update(lambda v: v if key in v else v | {key: {"last_run": v.get(WATERMARK)}})
        last = values[key]["last_run"]
        rows = batch.withColumn("when", lateness(F.col(ts), dt.datetime.fromisoformat(last) if last else None)).persist()
        try:
            rows.write.mode("overwrite").partitionBy("when").parquet(f"{path}/batch={number}")
            counts = {r["when"]: r["n"] for r in rows.groupBy("when").agg(F.count("*").alias("n")).collect()}
        finally:
            rows.unpersist()
        runs.state.update(lambda v: v | {key: {"last_run": last, "on_time": counts.get("on_time", 0), "late": counts.get("late", 0)}})

    return write
