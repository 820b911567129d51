"""Month shards: files named by month, of which a window of time opens only its own."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.feeds import PULLS, read_jsonl
from tidewatch.sources.shared import names_in

PREFIX = "pulls-"


def months(start: dt.datetime, end: dt.datetime) -> list[str]:
    """The months that [start, end) touches, as YYYY-MM."""
    out, (y, m) = [], (start.year, start.month)
    last = end - dt.timedelta(microseconds=1)
    while (y, m) <= (last.year, last.month):
        out.append(f"{y}-{m:02d}")
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    return out


def read_window(spark: SparkSession, folder: str, start: dt.datetime, end: dt.datetime, schema: str = PULLS, ts: str = "ts") -> DataFrame:
    """Rows of [start, end) from the shards `pulls-YYYY-MM*` of a folder, with columns ym and file.

    Only the shards of the window's months are opened. A shard is a JSONL file or a folder of them; shards whose lines lack fields of
    the schema give nulls, more fields are left out, and a missing shard is an empty one. No shard at all gives no rows.
    """
    wanted = tuple(f"{PREFIX}{m}" for m in months(start, end))
    paths = [f"{folder}/{n}" for n in names_in(spark, folder) if n.startswith(wanted)]
    if not paths:
        return spark.createDataFrame([], schema).withColumns({"ym": F.lit(None).cast("string"), "file": F.lit(None).cast("string")})
    rows = read_jsonl(spark, paths, schema).withColumn("file", F.col("_metadata.file_path"))
    rows = rows.withColumn("ym", F.regexp_extract("file", PREFIX + r"(\d{4}-\d{2})", 1))
    return rows.filter((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))


def write_shards(rows: DataFrame, folder: str, ts: str = "ts") -> None:
    """Rows appended to one shard folder a month; a null time goes to no shard. Months are few, and each is written by the tasks that hold its rows."""
    dated = rows.filter(F.col(ts).isNotNull()).withColumn("ym", F.date_format(ts, "yyyy-MM")).persist()
    try:
        for r in dated.select("ym").distinct().orderBy("ym").collect():
            dated.filter(F.col("ym") == r["ym"]).drop("ym").write.mode("append").json(f"{folder}/{PREFIX}{r['ym']}")
    finally:
        dated.unpersist()
