"""Tables that results are kept in: plain Parquet, partitioned for the reads that follow."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import dedup


def append_pulls(pulls: DataFrame, path: str, dry_run: bool = False) -> None:
    """Appends pull rows by month, so a replay reads the months of its window only."""
    if not dry_run:
        pulls.withColumn("ym", F.date_format("ts", "yyyy-MM")).write.mode("append").partitionBy("ym").parquet(path)


def merge_ledger(old: DataFrame, new: DataFrame, path: str) -> str:
    """Writes the merged ledger as a new version beside the old one and returns its folder: readers never see half of it."""
    version = f"{path}/v-{uuid.uuid4().hex}"
    dedup.upsert(old, new).write.parquet(version)
    return version
