"""Exclusion, track, machine types and focus tags from keywords; keywords match as substrings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions import fixed as K


def haystack(title: Column, text: Column) -> Column:
    return F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" \n "), F.coalesce(text, F.lit(""))))


def hits(hay: Column, keywords: list[str]) -> Column:
    return sum((F.contains(hay, F.lit(k)).cast("int") for k in keywords), F.lit(0))


def exclude_reason(hay: Column) -> Column:
    """The first excluded phrase that a text has, or null."""
    return F.coalesce(*[F.when(F.contains(hay, F.lit(x)), x) for x in K.EXCLUDE])


def track(hay: Column) -> Column:
    """struct<track, track_matched>: most hits, then the greater weight, then the earlier track; without hits the first track."""
    ranks = [F.struct(hits(hay, words).alias("n"), F.lit(weight).alias("w"), F.lit(-i).alias("o"), F.lit(name).alias("track")) for i, (name, weight, words) in enumerate(K.TRACKS)]
    best = F.array_max(F.array(*ranks))
    return F.struct(F.when(best["n"] > 0, best["track"]).otherwise(K.TRACKS[0][0]).alias("track"), (best["n"] > 0).alias("track_matched"))


def machine_types(hay: Column) -> Column:
    found = F.array_sort(F.array_compact(F.array(*[F.when(hits(hay, words) > 0, name) for name, words in K.MACHINE_TYPES.items()])))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("tool-saas")))


def focus_tags(hay: Column) -> Column:
    tags = [F.when(hits(hay, [t for t in topic.lower().split() if len(t) > 3]) > 0, topic) for topic in K.FOCUS_TOPICS]
    return F.array_sort(F.array_compact(F.array(*tags)))
