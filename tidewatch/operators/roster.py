"""The roster of followed accounts as a table: validation, lookup, changes and the plan of a run's pulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import text as T

FIELDS = "handle string, track string, tier int, enabled boolean, added_at string, provenance string, topic_filter string, notes string"
FAVES_FLOOR = 500


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """Entries of roster files, each an object with `entries` or a bare list; what is neither gives no rows. pos keeps the order."""
    texts = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<struct<{FIELDS}>>")
    held = F.from_json("value", f"struct<entries: array<struct<{FIELDS}>>>")["entries"]
    entries = F.when(F.ltrim("value").startswith("["), listed).otherwise(held)
    return texts.select(F.posexplode(entries).alias("pos", "e")).select("pos", "e.*")


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""


def entry_errors() -> Column:
    """array<string>: what is wrong with one entry; empty if it is valid."""
    needed = [F.when(F.col(c).isNull(), f"missing {c}") for c in ("handle", "track", "tier", "enabled", "added_at", "provenance")]
    wrong = [
        F.when(F.col("handle").isNotNull() & _blank("handle"), "handle empty"),
        F.when(~_blank("handle") & ~T.bare_handle(F.col("handle")).rlike(T.HANDLE), "handle malformed"),
        F.when(F.col("track").isNotNull() & _blank("track"), "track empty"),
        F.when(~F.col("tier").isin(1, 2), "tier not 1 or 2"),
        F.when(~F.col("provenance").isin("seed", "approved"), "provenance unknown"),
        F.when(F.col("added_at").isNotNull() & F.try_to_timestamp(F.col("added_at")).isNull(), "added_at no time"),
        F.when(F.col("topic_filter").isNotNull() & _blank("topic_filter"), "topic_filter empty"),
        F.when(F.col("notes").isNotNull() & _blank("notes"), "notes empty"),
    ]
    return F.array_compact(F.array(*needed, *wrong))


def validated(roster: DataFrame) -> DataFrame:
    """roster with errors, a repeated handle (without regard to case) included at each later row; pos tells the order.

    The first place of a handle is an aggregate that is joined, so no handle's rows meet in one task.
    """
    key = F.when(~_blank("handle"), T.handle_key(F.col("handle")))
    keyed = roster.withColumn("__key", key)
    first = keyed.filter("__key IS NOT NULL").groupBy("__key").agg(F.min("pos").alias("__first"))
    joined = keyed.join(first, "__key", "left")
    again = F.when(F.col("pos") > F.col("__first"), F.array(F.lit("duplicate handle"))).otherwise(F.array().cast("array<string>"))
    return joined.withColumn("errors", F.concat(entry_errors(), again)).drop("__key", "__first")


def set_enabled(roster: DataFrame, decisions: DataFrame) -> DataFrame:
    """roster with `enabled` as decided in (handle, enabled); nothing is deleted, and unknown handles change nothing."""
    wanted = decisions.groupBy(T.handle_key(F.col("handle")).alias("__key")).agg(F.bool_and("enabled").alias("__enabled"))
    joined = roster.join(wanted, T.handle_key(F.col("handle")) == F.col("__key"), "left")
    return joined.withColumn("enabled", F.coalesce("__enabled", "enabled")).select(*roster.columns)


def upsert(roster: DataFrame, entries: DataFrame) -> DataFrame:
    """roster with valid entries added, in place of those with their handle; an invalid entry raises and changes nothing."""
    checked = validated(entries)
    bad = checked.filter(F.size("errors") > 0).select("handle", "errors").first()
    if bad is not None:
        raise ValueError(f"entry {bad['handle']}: {', '.join(bad['errors'])}")
    keys = entries.select(T.handle_key(F.col("handle")).alias("__key")).distinct()
    rest = roster.join(keys, T.handle_key(F.col("handle")) == F.col("__key"), "left_anti")
    return rest.unionByName(entries.select(*[c for c in roster.columns if c in entries.columns]), allowMissingColumns=True)


def pull_plan(roster: DataFrame, tier: int = 1, min_faves: float = 0, pre_viral: float = FAVES_FLOOR, most: int | None = None) -> DataFrame:
    """(pos, handle, track, tier, topic_filter, min_faves): what a run pulls, in roster order; `most` bounds a day's calls.

    The floor of likes is clamped to 0 and the lesser of FAVES_FLOOR and the pre-viral bar, so no setting blinds the pulls.
    """
    cap = pre_viral if 0 <= pre_viral < FAVES_FLOOR else FAVES_FLOOR
    floor = int(max(0, min(cap, min_faves)))
    chosen = roster.filter((F.col("tier") == tier) & F.col("enabled") & ~_blank("handle"))
    topic = F.when(~_blank("topic_filter"), F.col("topic_filter"))
    plan = chosen.select("pos", T.bare_handle(F.col("handle")).alias("handle"), "track", "tier", topic.alias("topic_filter"), F.lit(floor).alias("min_faves"))
    return plan if most is None else plan.orderBy("pos").limit(most)
