"""The folder that all machines see, and tables that are kept in it while a job runs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; one of our own in local runs only."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a shared folder")
        folder = tempfile.mkdtemp(prefix="tidewatch-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, for what is read more than once: made once, and a lost executor costs a reread.

    Like the files of `checkpoint()`, such tables stay in the folder until it is cleared.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of a folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, sorted; none if there is no such folder."""
    fs, place = hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, place = hadoop(spark, path)
    fs.delete(place, True)
