"""Exemptions joined with findings: the most specific grant whose scope covers a finding suppresses it.

Findings and grants may both be many and meet on few keys, so they never meet pair by pair. The grants on a key (token,
repository, prefix) differ for a finding only in when they expire and where they apply; `_spans` cuts a key's time at the
expiries of its grants, and of each span holds the first grant that applies. A finding meets one span a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.sources.shared import kept

ANY = "*"
KEY = ["token", "repo", "prefix"]


def path_heads(path: Column) -> Column:
    """All prefixes of a path that end at a slash or at its end, the empty one first; null is the empty path."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def _applies(scope: Column, past: Column) -> Column:
    return F.coalesce((scope == "all") | ((scope == "history-only") & past), F.lit(False))


def _held(grants: DataFrame) -> DataFrame:
    """(pos, token, repo, prefix, expires, in_past, in_now): grants by key, and whether they apply to findings in history and to others."""
    prefix = F.trim(F.coalesce("prefix", F.lit("")), F.lit("/"))
    return grants.select(
        "pos", F.lower("token").alias("token"), F.coalesce("repo", F.lit(ANY)).alias("repo"), prefix.alias("prefix"), "expires",
        _applies(F.col("scope"), F.lit(True)).alias("in_past"), _applies(F.col("scope"), F.lit(False)).alias("in_now"),
    )


def _spans(held: DataFrame) -> DataFrame:
    """(key, since, until, past_pos, now_pos): the spans of time of each key that has grants, a null end being open.

    A row for each expiry of a key's grants; what is over when all have expired has none.
    """
    pos = lambda c: F.min(F.when(F.col(c), F.col("pos")))
    ends = held.groupBy(*KEY, F.col("expires").alias("until")).agg(pos("in_past").alias("p"), pos("in_now").alias("n"))
    # a grant holds in the span that it ends and in all before it
    later = Window.partitionBy(*KEY).orderBy(F.desc_nulls_first("until"))
    since = F.lead("until").over(later)
    return kept(ends.select(*KEY, since.alias("since"), "until", F.min("p").over(later).alias("past_pos"), F.min("n").over(later).alias("now_pos")), "grant-spans")


def _met(findings: DataFrame, spans: DataFrame) -> DataFrame:
    """(finding, past, key, until, pos, place): the span of each key above a finding, and the first grant in it that applies.

    A finding is exploded to the scopes above it (each head of its path, in its repository and in any), so scopes meet by
    equality. `place` orders them: its repository before any, longer prefixes before shorter ones.
    """
    scopes = F.flatten(F.transform(path_heads(F.col("path")), lambda h: F.transform(F.array_distinct(F.array(F.coalesce("repo", F.lit(ANY)), F.lit(ANY))), lambda r: F.struct(r.alias("repo"), h.alias("prefix")))))
    asked = findings.filter("domain IS NOT NULL").select("finding", F.lower("token").alias("token"), (F.col("domain") == "history").alias("past"), "at", F.explode(scopes).alias("s")).select("finding", "token", "past", "at", "s.*")
    # a finding without a time comes before every expiry
    within = (F.col("since").isNull() | (F.col("at") >= F.col("since"))) & (F.col("until").isNull() | F.col("at").isNull() | (F.col("at") < F.col("until")))
    within &= F.col("since").isNull() | F.col("at").isNotNull()
    depth = F.when(F.col("prefix") == "", 0).otherwise(F.size(F.split("prefix", "/")))
    place = F.struct((F.col("repo") == ANY).alias("any"), (-depth).alias("depth"))
    return asked.join(spans, KEY).filter(within).select("finding", "past", *KEY, "until", F.when(F.col("past"), F.col("past_pos")).otherwise(F.col("now_pos")).alias("pos"), place.alias("place"))


def granted(findings: DataFrame, grants: DataFrame) -> DataFrame:
    """findings with grant_pos: the grant that suppresses each, or null. A finding is judged by its `finding` id, which must be its own.

    findings: (finding, token, domain, repo, path, at). grants: (pos, token, scope, repo, prefix, expires), where a null repo or
    prefix covers all of them and a null expiry never comes; `pos`, the order of declaration, is a grant's own. A grant that
    had expired when the finding was made doesn't cover it, and a history-only grant doesn't apply in another domain. The
    finding's repository goes before any, longer prefixes before shorter ones, then the order of declaration. Tokens compare
    without regard to case; a null token or domain meets nothing.
    """
    met = _met(findings, _spans(_held(grants))).filter("pos IS NOT NULL")
    best = met.groupBy("finding").agg(F.min(F.struct("place", "pos")).alias("b"))
    return findings.join(best.select("finding", F.col("b.pos").alias("grant_pos")), "finding", "left")


def grant_uses(findings: DataFrame, grants: DataFrame) -> DataFrame:
    """(pos, token, suppressed, live_collisions) of every grant.

    A history-only grant collides with each live finding that it would have covered and that no grant before it in rank
    suppresses: what was accepted in the past turns up in what is written now. Findings are counted by key and span; the spans
    before a grant's expiry in which no grant before it applies are those it collides in.
    """
    held = _held(grants)
    met = _met(findings, _spans(held))
    best = F.min(F.when(F.col("pos").isNotNull(), F.col("place"))).over(Window.partitionBy("finding"))
    # nothing above the best place of a finding is suppressed there, and what lies beyond it is out of the question
    first = met.withColumn("best", best).filter("best IS NULL OR place <= best")
    seen = first.groupBy("past", *KEY, "until", F.col("pos").alias("first_pos")).agg(F.count("*").alias("n"))
    hits = seen.filter("first_pos IS NOT NULL").groupBy(F.col("first_pos").alias("pos")).agg(F.sum("n").alias("suppressed"))
    idle = held.select("pos", *KEY, "expires", F.explode(F.array_compact(F.array(F.when(~F.col("in_past"), True), F.when(~F.col("in_now"), False)))).alias("past"))
    met_idle = (F.col("expires").isNull() | (F.col("until") <= F.col("expires"))) & (F.col("first_pos").isNull() | (F.col("pos") < F.col("first_pos")))
    runs = idle.join(seen, [*KEY, "past"]).filter(met_idle).groupBy("pos").agg(F.sum("n").alias("live_collisions"))
    return grants.select("pos", "token").join(hits, "pos", "left").join(runs, "pos", "left").na.fill(0, ["suppressed", "live_collisions"])


def grant_receipt(findings: DataFrame, grants: DataFrame) -> DataFrame:
    """One row (declared, used, never_fired, collided, collisions); without grants all are 0."""
    used = F.count_if(F.col("suppressed") > 0)
    totals = grant_uses(findings, grants).agg(F.count("*").alias("declared"), used.alias("used"), F.count_if(F.col("live_collisions") > 0).alias("collided"), F.coalesce(F.sum("live_collisions"), F.lit(0)).alias("collisions"))
    return totals.select("declared", "used", (F.col("declared") - F.col("used")).alias("never_fired"), "collided", "collisions")
