"""Yield of origins: contributions to opportunities over pulls, and the decisions that follow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import fixed as K


def window_of(ts: Column, start: Column, end: Column) -> Column:
    """Half-open: start <= ts < end; a null time is out."""
    return F.coalesce((ts >= start) & (ts < end), F.lit(False))


def week_bucket(ts: Column, now: Column) -> Column:
    """Trailing seven-day buckets from now, 0 the newest: [now - 7(k+1) d, now - 7k d); the future is negative."""
    week = 7 * 86_400_000_000
    return F.floor((F.unix_micros(now) - F.unix_micros(ts) - 1) / F.lit(week)).cast("int")


def numerator(evidence: DataFrame, start: Column, end: Column) -> DataFrame:
    """(kind, name, contributions, pushed, pre_viral) of rows (opp_id, ts, kind, name, pushed, faves).

    Rows of one opportunity count once for an origin, however often it was archived.
    """
    inside = evidence.filter(window_of(F.col("ts"), start, end))
    each = inside.groupBy("opp_id", "kind", "name").agg(F.max(F.coalesce(F.col("faves") < K.PRE_VIRAL_FAVES, F.lit(False))).alias("early"))
    opps = inside.groupBy("opp_id").agg(F.max(F.coalesce("pushed", F.lit(False))).alias("pushed"))
    return each.join(opps, "opp_id").groupBy("kind", "name").agg(F.count("*").alias("contributions"), F.count_if("pushed").alias("pushed"), F.count_if("early").alias("pre_viral"))


def denominator(pulls: DataFrame, start: Column, end: Column) -> DataFrame:
    """(kind, name, pulls, kept) of rows (kind, name, ts, kept): lines are counted, not what they pulled."""
    inside = pulls.filter(window_of(F.col("ts"), start, end))
    return inside.groupBy("kind", "name").agg(F.count("*").alias("pulls"), F.sum(F.coalesce(F.col("kept").cast("long"), F.lit(0))).alias("kept"))


def ratios(up: DataFrame, down: DataFrame) -> DataFrame:
    """Full outer on the origin; the ratio is null, not 0, where nothing was pulled."""
    joined = up.join(down, ["kind", "name"], "full_outer").na.fill(0)
    return joined.withColumn("yield", F.round(F.try_divide(F.col("contributions"), F.nullif(F.col("pulls"), F.lit(0))), 6))


def weekly(pulls: DataFrame, evidence: DataFrame, now: Column, weeks: int) -> DataFrame:
    """(name, week, pulls, contributions) for weeks 0 to weeks - 1 of each name that was pulled at all, zeros filled in."""
    names = pulls.select("name").distinct().select("name", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))).alias("week"))
    p = pulls.withColumn("week", week_bucket(F.col("ts"), now)).groupBy("name", "week").agg(F.count("*").alias("pulls"))
    c = evidence.withColumn("week", week_bucket(F.col("ts"), now)).groupBy("name", "week").agg(F.countDistinct("opp_id").alias("contributions"))
    return names.join(p, ["name", "week"], "left").join(c, ["name", "week"], "left").na.fill(0)


def prune(roster: DataFrame, weeks: DataFrame, spared: DataFrame, floor: int = K.FLOOR) -> DataFrame:
    """Enabled names pulled in every week with no more than `floor` contributions in any, and not in `spared`."""
    dead = weeks.groupBy("name").agg(F.every((F.col("pulls") >= 1) & (F.col("contributions") <= floor)).alias("dead")).filter("dead")
    return roster.filter("enabled").join(dead, "name", "left_semi").join(spared, "name", "left_anti")


def propose(evidence: DataFrame, roster: DataFrame, least: int = K.PROPOSE_MIN) -> DataFrame:
    """Names outside the roster with enough opportunities: (name, n_opps, tracks, sample_url).

    sample_url is the first address that is not blank of a name's evidence, by `pos` (then by address); null without columns
    pos and url, or if it has none.
    """
    fresh = evidence.join(roster.select("name"), "name", "left_anti")
    url = F.lit(None).cast("string")
    if {"pos", "url"} <= {*evidence.columns}:
        url = F.min(F.when(F.trim("url") != "", F.struct("pos", "url")))["url"]
    found = fresh.groupBy("name").agg(F.countDistinct("opp_id").alias("n_opps"), F.array_join(F.array_sort(F.collect_set("track")), ",").alias("tracks"), url.alias("sample_url"))
    return found.filter(F.col("n_opps") >= least)


def history_days(pulls: DataFrame, evidence: DataFrame, now: Column) -> DataFrame:
    """One row (days): from the first dated pull to now; without a dated pull from the first dated record; 0 without either, or if it lies ahead."""
    first = pulls.agg(F.min("ts").alias("a")).crossJoin(evidence.agg(F.min("ts").alias("b")))  # one row each
    days = (F.unix_micros(now) - F.unix_micros(F.coalesce("a", "b"))) / F.lit(86_400_000_000)
    return first.select(F.greatest(F.lit(0.0), F.coalesce(days, F.lit(0.0))).alias("days"))


def sets_compared(old: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """(key, in_both, only_new, only_old) of the union of two sets: intersection, both differences, and so the symmetric one, in one full join. Null is an element like any other."""
    a = old.select(key).distinct().select(F.col(key).alias("__a"), F.lit(True).alias("o"))
    b = new.select(key).distinct().select(F.col(key).alias("__b"), F.lit(True).alias("n"))
    j = a.join(b, F.col("__a").eqNullSafe(F.col("__b")), "full_outer")
    return j.select(F.when(F.col("o"), F.col("__a")).otherwise(F.col("__b")).alias(key), (F.col("o").isNotNull() & F.col("n").isNotNull()).alias("in_both"), F.col("o").isNull().alias("only_new"), F.col("n").isNull().alias("only_old"))


def suggest_filters(ratio: DataFrame, roster: DataFrame) -> DataFrame:
    """Rostered names without a filter that are pulled often and contribute something, but rarely."""
    bare = roster.filter(F.coalesce(F.trim("topic_filter"), F.lit("")) == "").select("name")
    return ratio.join(bare, "name", "left_semi").filter((F.col("pulls") >= K.NOISY_PULLS) & (F.col("contributions") >= 1) & (F.col("yield") < K.NOISY_YIELD))


def identity_flags(roster: DataFrame, sweep: DataFrame) -> DataFrame:
    """(name, flag): dead where the sweep found nobody or no posts, drift where it found another name; unswept names have no row."""
    seen = roster.select("name").join(sweep, "name")
    dead = F.col("found_name").isNull() | (F.coalesce("posts", F.lit(0)) == 0)
    drift = F.lower("found_name") != F.lower("name")
    return seen.withColumn("flag", F.when(dead, "dead").when(drift, "drift")).filter("flag IS NOT NULL").select("name", "flag")


def report(roster: DataFrame, evidence: DataFrame, pulls: DataFrame, now: Column, sweep: DataFrame | None = None, apply: bool = False, floor: int = K.FLOOR, pre_viral: float = K.PRE_VIRAL_FAVES) -> DataFrame:
    """(section, name): the week's prune, disabled, propose_add, suggest_filters, drift and dead names.

    Nothing is pruned before the records go back MIN_HISTORY_DAYS; names with an early find in the window are spared.
    With `apply` the pruned names count as disabled too. Nothing is ever added to the roster. Names are handles.
    """
    start = now - F.expr(f"INTERVAL {K.WINDOW_DAYS} DAYS")
    found, pulled = evidence.filter("kind = 'handle'"), pulls.filter("kind = 'handle'")
    inside = found.filter(window_of(F.col("ts"), start, now))
    spared = inside.filter(F.col("faves") < pre_viral).select("name").distinct()
    warm = history_days(pulls, evidence, now).filter(F.col("days") >= K.MIN_HISTORY_DAYS).select(F.lit(True).alias("warm"))
    out = prune(roster, weekly(pulled, found, now, K.PRUNE_WEEKS), spared, floor).select("name").join(F.broadcast(warm), how="cross").select("name")  # warm: at most one row
    off = roster.filter(~F.col("enabled")).select("name")
    ratio = ratios(numerator(found, start, now), denominator(pulled, start, now))
    parts = {"prune": out, "disabled": off.union(out) if apply else off, "propose_add": propose(inside, roster), "suggest_filters": suggest_filters(ratio, roster)}
    rows = [d.select(F.lit(section).alias("section"), F.col("name").cast("string")) for section, d in parts.items()]
    if sweep is not None:
        rows.append(identity_flags(roster, sweep).select(F.col("flag").alias("section"), F.col("name").cast("string")))
    return reduce(DataFrame.unionByName, rows)


def marked_once(markers: DataFrame, runs: DataFrame) -> DataFrame:
    """markers (label, at) with a row for each label of `runs` that had none; a label marked before stays as it was."""
    fresh = runs.groupBy("label").agg(F.min("at").alias("at")).join(markers.select("label"), "label", "left_anti")
    return markers.select("label", "at").unionByName(fresh.select("label", "at"))


def missed_dates(last: Column, today: Column, most: int = 30) -> Column:
    """The days after `last` up to today, the newest `most`; none if last is today or later."""
    first = F.greatest(F.date_add(last, 1), F.date_sub(today, most - 1))
    return F.when(first <= today, F.sequence(first, F.greatest(first, today))).otherwise(F.array().cast("array<date>"))
