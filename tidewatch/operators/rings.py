"""Ring buffers: the last samples of each key, as an aggregate whose partial results are as small as its result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import fixed as K


def ring_buffer(rows: DataFrame, key: str, order: list[str], fields: list[str], most: int = K.SAMPLES_CAP, out: str = "samples") -> DataFrame:
    """(key, samples): an array of structs of `order` and `fields`, the last `most` rows of each key, the oldest first.

    `order` says which rows are later; of rows equal in it those with greater fields are. Spark limits the ranks in each task before the
    shuffle, so a key with most of the rows sends at most `most` rows a task. A null key is a key.
    """
    names = [*order, *[f for f in fields if f not in order]]
    last = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in names]))
    few = rows.select(key, *names).withColumn("__n", last).filter(F.col("__n") <= most)
    return few.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*names))).alias(out))


def merge_rings(old: DataFrame, new: DataFrame, key: str, most: int = K.SAMPLES_CAP, out: str = "samples") -> DataFrame:
    """Two tables of ring buffers as one: the same as the ring buffer of all rows behind both."""
    names = old.schema[out].dataType.elementType.fieldNames()
    rows = old.select(key, F.inline(out)).unionByName(new.select(key, F.inline(out)))
    return ring_buffer(rows, key, names, [], most, out)
