"""The rumour lane: which single-origin items are shown, and what is remembered of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import fixed as K


def select_rendered(items: DataFrame, seen: DataFrame, cap: int = K.PULSE_CAP) -> DataFrame:
    """The `cap` best unseen items, one for each key (the first by pos): rank, then the newest, then the title."""
    fresh = items.filter("pulse_key <> ''").join(seen.select("pulse_key"), "pulse_key", "left_anti")
    first = fresh.groupBy("pulse_key").agg(F.min_by(F.struct(*[c for c in fresh.columns if c != "pulse_key"]), "pos").alias("i")).select("pulse_key", "i.*")
    return first.orderBy(F.desc("rank"), F.desc_nulls_last("ts"), "title").limit(cap)


def merge_seen(seen: DataFrame, shown: DataFrame, now: Column, days: int = K.PULSE_RETENTION_DAYS) -> DataFrame:
    """(pulse_key, last_shown) of the last `days`, the cutoff included; only what was shown is stamped."""
    every = seen.unionByName(shown.select("pulse_key", now.alias("last_shown"))).groupBy("pulse_key").agg(F.max("last_shown").alias("last_shown"))
    return every.filter(F.col("last_shown") >= now - F.make_dt_interval(F.lit(days)))


def per_side(cards: DataFrame, cap: int, score: str = "final_score", id_col: str = "id") -> DataFrame:
    """(side, shown, overflow) with the positions of the best `cap` cards of each side."""
    rn = F.row_number().over(Window.partitionBy("side").orderBy(F.desc(score), id_col))
    return cards.withColumn("rn", rn)
