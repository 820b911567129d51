"""Origins of evidence: distinct and independent counts, and where a candidate goes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions import fixed as K


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def origin_of(e: Column) -> Column:
    """An item's origin, or its source where that is missing or empty, lower-cased."""
    return F.lower(F.when(_text(e["origin"]) != "", e["origin"]).otherwise(_text(e["source"])))


def distinct_origins(evidence: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(evidence, origin_of), lambda o: o != "")))


def independent_sources(evidence: Column) -> Column:
    """Distinct origins, less those whose every item is a quote by another present origin; at most as many as distinct URLs if all items have one."""
    origins = distinct_origins(evidence)
    label = lambda e: F.trim(origin_of(e))
    parent = lambda e: F.when(F.trim(_text(e["via_handle"])) != "", F.concat(F.lit("x.com/"), F.lower(F.regexp_replace(F.trim(e["via_handle"]), "^@", ""))))

    def derived(o: Column) -> Column:
        own = F.filter(evidence, lambda e: label(e) == o)
        return (F.size(own) > 0) & F.forall(own, lambda e: F.coalesce((parent(e) != o) & F.array_contains(origins, parent(e)), F.lit(False)))

    kept = F.size(F.filter(origins, lambda o: ~derived(o)))
    urls = F.transform(evidence, lambda e: F.lower(F.trim(_text(e["url"]))))
    capped = F.least(kept, F.size(F.array_distinct(urls)))
    return F.when((F.size(urls) > 0) & F.forall(urls, lambda u: u != ""), capped).otherwise(kept)


def is_community(e: Column, sources: list[str] = K.COMMUNITY_SOURCES) -> Column:
    labels = F.array(*[F.lower(F.trim(_text(e[f]))) for f in ("origin_source", "source", "origin")])
    return F.arrays_overlap(labels, F.array(*[F.lit(s) for s in sources]))


def pulse_eligible(excluded: Column, track_matched: Column, community: Column, age_hours: Column) -> Column:
    fresh = F.greatest(F.coalesce(age_hours, F.lit(0.0)), F.lit(0.0)) <= K.PULSE_MAX_AGE_H
    return ~excluded & track_matched & community & fresh


def lane(n_sources: Column, eligible: Column, least: int = K.MIN_SOURCES) -> Column:
    """card with enough independent sources, else pulse where eligible, else below_sources."""
    return F.when(n_sources >= least, "card").when(eligible, "pulse").otherwise("below_sources")
