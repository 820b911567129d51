"""Replay over checkpoints: what a run at each of them would have seen, for all checkpoints in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import fixed as K

MICROS = 86_400_000_000


def checkpoints(first: str, last: str, days: int = 7) -> Column:
    """Array of times from `first` to `last`, every `days` days."""
    return F.sequence(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp"), F.expr(f"INTERVAL {days} DAYS"))


def seen_at(ts: Column, times: Column, days: int) -> Column:
    """The checkpoints at which a row of that time lies in the window of `days` days before them: [c - days, c). A null time is in none.

    That is a few checkpoints a row, however many there are: nothing from after a checkpoint is visible at it.
    """
    return F.filter(times, lambda c: (ts < c) & (F.unix_micros(c) - F.unix_micros(ts) <= days * MICROS))


def replay_yields(evidence: DataFrame, pulls: DataFrame, times: Column, days: int = K.WINDOW_DAYS) -> DataFrame:
    """(checkpoint, kind, name, contributions, pulls, yield): the yields that a run at each checkpoint would have reported.

    Rows are those of `yields.numerator` and `yields.denominator`. All checkpoints are computed together: a row goes to the
    checkpoints that see it, and each (checkpoint, origin) is a group.
    """
    up = evidence.select("opp_id", "kind", "name", F.explode(seen_at(F.col("ts"), times, days)).alias("checkpoint"))
    up = up.groupBy("checkpoint", "kind", "name").agg(F.count_distinct("opp_id").alias("contributions"))
    down = pulls.select("kind", "name", F.explode(seen_at(F.col("ts"), times, days)).alias("checkpoint")).groupBy("checkpoint", "kind", "name").agg(F.count("*").alias("pulls"))
    both = up.join(down, ["checkpoint", "kind", "name"], "full_outer").na.fill(0, ["contributions", "pulls"])
    return both.withColumn("yield", F.round(F.try_divide(F.col("contributions"), F.nullif(F.col("pulls"), F.lit(0))), 6))


def replay_prunes(roster: DataFrame, evidence: DataFrame, pulls: DataFrame, times: Column, weeks: int = K.PRUNE_WEEKS, floor: int = K.FLOOR, pre_viral: float = K.PRE_VIRAL_FAVES) -> DataFrame:
    """(name, disabled_at): the first checkpoint at which a weekly run that prunes would have disabled each enabled name.

    A run prunes a name with pulls and at most `floor` opportunities in each of the last `weeks` weeks and no early find in the
    window. What is disabled stays so, so the first such checkpoint says all about the names at every later one.
    """
    week = lambda ts: F.floor((F.unix_micros("checkpoint") - F.unix_micros(ts) - 1) / F.lit(7 * MICROS)).cast("int")
    at = lambda df, days: df.filter("kind = 'handle'").withColumn("checkpoint", F.explode(seen_at(F.col("ts"), times, days)))
    p = at(pulls, 7 * weeks).withColumn("week", week("ts")).groupBy("name", "checkpoint", "week").agg(F.count("*").alias("pulls"))
    c = at(evidence, 7 * weeks).withColumn("week", week("ts")).groupBy("name", "checkpoint", "week").agg(F.count_distinct("opp_id").alias("found"))
    poor = p.join(c, ["name", "checkpoint", "week"], "left").filter(F.coalesce("found", F.lit(0)) <= floor)
    dead = poor.groupBy("name", "checkpoint").agg(F.count("*").alias("n")).filter(F.col("n") == weeks)
    spared = at(evidence, K.WINDOW_DAYS).filter(F.col("faves") < pre_viral).select("name", "checkpoint").distinct()
    first = dead.join(spared, ["name", "checkpoint"], "left_anti").groupBy("name").agg(F.min("checkpoint").alias("disabled_at"))
    return roster.filter("enabled").select("name").join(first, "name")


def last_known(rows: DataFrame, key: str, ts: str, times: Column, fields: list[str]) -> DataFrame:
    """(checkpoint, key, fields): each key's last row at or before each checkpoint; keys not yet seen have none.

    A row is first seen at one checkpoint. The last row of each key and first checkpoint is kept, then carried forward
    to the checkpoint before the key's next one, so only what the answer holds is exploded.
    """
    at = F.array_min(F.filter(times, lambda c: c >= F.col(ts)))
    firsts = rows.withColumn("checkpoint", at).filter("checkpoint IS NOT NULL").groupBy(key, "checkpoint").agg(F.max(F.struct(ts, *fields)).alias("r")).select(key, "checkpoint", *[F.col(f"r.{f}").alias(f) for f in fields])
    until = F.lead("checkpoint").over(Window.partitionBy(key).orderBy("checkpoint"))
    carried = firsts.withColumn("until", until)
    span = F.filter(times, lambda c: (c >= F.col("checkpoint")) & (F.col("until").isNull() | (c < F.col("until"))))
    return carried.select(F.explode(span).alias("checkpoint"), key, *fields)
