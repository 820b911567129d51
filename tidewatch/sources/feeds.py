"""Raw feeds to signal rows. Every reader has an explicit schema; malformed input degrades to nulls or no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import text as T

EVIDENCE = "struct<source: string, origin: string, url: string, signal: string, ts: string, origin_handle: string, origin_source: string, via_handle: string, faves: double, heat: double>"
CANDIDATE = (
    f"title string, summary string, entities array<string>, evidence array<{EVIDENCE}>, "
    "score_breakdown struct<track_fit: double, timing: double, feasibility: double, competition: double, executability: double>, "
    "age_hours double, velocity double, lifecycle_stage string, why_now string, contrarian_insight string, action string, track string, "
    "side string, pain_evidence string, crowdedness double"
)
ARCHIVE = f"opportunity_id string, canonical_key string, first_seen timestamp, last_seen timestamp, pushed boolean, track string, title string, evidence array<{EVIDENCE}>"
PULLS = "run_id string, ts timestamp, handle string, source string, pulled int, kept int"
TOPIC = "id: bigint, title: string, url: string, content: string, replies: int, created: double, node: struct<id: bigint, name: string, title: string>"
QUOTED = "struct<url: string, text: string, likeCount: double, createdAt: string, author: struct<userName: string>>"
TIMELINE = f"userName string, tweets array<struct<id: string, url: string, text: string, likeCount: double, createdAt: string, isReply: boolean, isQuote: boolean, author: struct<userName: string>, quoted_tweet: {QUOTED}>>"
ITEM = "title string, link string, description string, pubDate string, category string"
SIGNAL = ("source", "origin", "url", "signal", "ts", "origin_handle", "origin_source", "via_handle", "faves", "heat", "category", "title", "track")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines of JSONL files that hold one JSON object; blank and corrupt ones are left out. A glob reads many months.

    Bytes that are no UTF-8 are replaced and their line stays, and so does a line with a value of another type, which is null.
    """
    line = F.trim(F.regexp_replace(F.make_valid_utf8("value"), "^\ufeff", ""), F.lit(" \t\r"))
    lines = spark.read.text(path).withColumn("value", line)
    # within brackets a line that is torn, or that two records share, is no JSON or no list of one
    whole = F.startswith("value", F.lit("{")) & (F.json_array_length(F.concat(F.lit("["), "value", F.lit("]"))) == 1)
    return lines.filter(whole).select(F.from_json("value", schema).alias("r")).select("r.*")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidates from a JSON list, or from an object that holds one; a malformed file gives _corrupt_record."""
    wrapped = spark.read.schema(f"candidates array<struct<{CANDIDATE}>>, {CANDIDATE}, _corrupt_record string").option("multiLine", True).json(path)
    listed = wrapped.filter("candidates IS NOT NULL").select(F.inline("candidates"))
    plain = wrapped.filter("candidates IS NULL AND _corrupt_record IS NULL").drop("candidates", "_corrupt_record")
    return listed.unionByName(plain)


def posted_at(raw: Column) -> Column:
    """A post's time: '<weekday> Mon dd HH:mm:ss Z yyyy', else ISO 8601 (UTC where no zone is given), else null."""
    bare = F.regexp_replace(F.trim(raw), "^[A-Za-z]{3} ", "")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("MMM dd HH:mm:ss Z yyyy")), F.try_to_timestamp(F.trim(raw)))


def mail_date(raw: Column) -> Column:
    """An RFC-822 date, else ISO 8601, else null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), "^[A-Za-z]{3}, *", ""), "(GMT|UT|Z)$", "+0000")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.trim(raw)))


def epoch(seconds: Column) -> Column:
    """Epoch seconds; what is not finite or out of the range of years 1 to 9999 is null."""
    s = F.nanvl(seconds.cast("double"), F.lit(None).cast("double"))
    return F.when(s.between(-62135596800.0, 253402300799.0), F.timestamp_seconds(s))


def has_doctype(xml: Column) -> Column:
    """A DOCTYPE in the prolog, after a byte order mark, processing instructions and comments."""
    return F.regexp_replace(xml, "^﻿", "").rlike(r"(?is)^\s*(?:(?:<\?.*?\?>|<!--.*?-->)\s*)*<!DOCTYPE")


def parse_topics(raw: DataFrame, col: str = "body") -> DataFrame:
    """Forum topics of a JSON list: node name as category, replies as heat, creation time as ts."""
    topics = raw.select(F.inline(F.from_json(col, f"array<struct<{TOPIC}>>")))
    return topics.select(F.col("title"), F.col("url"), F.col("node.name").alias("category"), F.col("replies").cast("double").alias("heat"), epoch(F.col("created")).alias("ts"), F.coalesce("content", F.lit("")).alias("signal"))


def parse_rss(raw: DataFrame, col: str = "body") -> DataFrame:
    """Items of RSS documents; a document with a DOCTYPE has none, for entities in it are never expanded."""
    safe = raw.filter(~has_doctype(F.col(col)))
    items = safe.select(F.explode(F.regexp_extract_all(F.col(col), F.lit(r"(?s)(<item[ >].*?</item>)"), 1)).alias("x"))
    item = items.select(F.from_xml("x", ITEM).alias("i")).select("i.*")
    return item.select("title", F.trim("link").alias("url"), "category", mail_date(F.col("pubDate")).alias("ts"), F.coalesce("description", F.lit("")).alias("signal"))


def topic_match(text: Column, topic_filter: Column) -> Column:
    """Any term of the filter as a whole ASCII word; a filter that is empty or of operators only keeps all."""
    terms = F.filter(F.split(F.lower(F.coalesce(topic_filter, F.lit(""))), r"[\s()\"]+"), lambda t: (t != "") & ~t.isin("or", "and", "not") & ~t.startswith("-") & ~t.contains(":"))
    body = F.lower(F.coalesce(text, F.lit("")))
    word = lambda t: F.regexp_like(body, F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), t, F.lit(r"\E(?![A-Za-z0-9_])")))
    return (F.size(terms) == 0) | F.exists(terms, word)


def keep_drop(category: Column, keep: list[str] | None, drop: list[str] | None) -> Column:
    """A keep-list is a whitelist that a missing category fails; the drop-list follows."""
    name = F.lower(F.trim(category))
    kept = F.coalesce(name.isin([k.strip().lower() for k in keep]), F.lit(False)) if keep else F.lit(True)
    return kept & ~(F.coalesce(name.isin([d.strip().lower() for d in drop]), F.lit(False)) if drop else F.lit(False))


def fresh(ts: Column, last_run: Column) -> Column:
    """Not before the last run; an unknown time is kept."""
    return ts.isNull() | (ts >= last_run)


def collect_timelines(roster: DataFrame, responses: DataFrame, last_run: Column, min_faves: int = 0, tier: int = 1) -> tuple[DataFrame, DataFrame]:
    """(signals, pulls) of raw timeline responses (handle, body, pos) for the enabled handles of a tier.

    The last response of a handle counts: all rows of its greatest pos, so that a long timeline may come in many pages. A handle with a response gives one pull row, however little it holds; one
    without gives none. A quoted voice outside the roster is a signal of its own, marked with who quoted it.
    """
    plan = roster.filter((F.col("tier") == tier) & F.col("enabled") & (F.trim("handle") != "")).select(T.handle_key(F.col("handle")).alias("key"), F.col("handle"), "track", "topic_filter")
    pages = responses.select(T.handle_key(F.col("handle")).alias("key"), F.coalesce("pos", F.lit(0)).alias("pos"), "body")
    last = pages.groupBy("key").agg(F.max("pos").alias("pos"))
    pulled = pages.join(plan.join(last, "key"), ["key", "pos"]).withColumn("r", F.from_json("body", TIMELINE))
    posts = pulled.select("key", "handle", "track", "topic_filter", F.explode_outer("r.tweets").alias("t")).withColumn("ts", posted_at(F.col("t.createdAt")))
    ok = F.col("t").isNotNull() & fresh(F.col("ts"), last_run) & (F.coalesce("t.likeCount", F.lit(0.0)) >= min_faves) & topic_match(F.col("t.text"), F.col("topic_filter"))
    posts = posts.withColumn("kept", ok)
    pulls = posts.groupBy("key").agg(F.count("t").alias("pulled"), F.count_if("kept").alias("kept"))
    own = posts.filter("kept").select(F.concat(F.lit("x.com/"), "key").alias("origin"), F.col("t.url").alias("url"), F.col("t.text").alias("signal"), "ts", F.col("handle").alias("origin_handle"), F.lit(None).cast("string").alias("via_handle"), F.col("t.likeCount").alias("faves"), "track")
    voice = T.handle_key(F.col("t.quoted_tweet.author.userName"))
    quoted = posts.filter("kept").withColumn("voice", voice).filter(F.col("voice").rlike("^[a-z0-9_]{1,15}$") & (F.col("voice") != F.col("key")))
    quoted = quoted.join(roster.select(T.handle_key(F.col("handle")).alias("voice")), "voice", "left_anti")
    quoted = quoted.select(F.concat(F.lit("x.com/"), "voice").alias("origin"), F.col("t.quoted_tweet.url").alias("url"), F.col("t.quoted_tweet.text").alias("signal"), posted_at(F.col("t.quoted_tweet.createdAt")).alias("ts"), F.col("t.quoted_tweet.author.userName").alias("origin_handle"), F.col("handle").alias("via_handle"), F.col("t.quoted_tweet.likeCount").alias("faves"), "track")
    return own.unionByName(quoted), pulls


def collect_community(items: DataFrame, source: str, last_run: Column, keep: list[str] | None = None, drop: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(signals, one pull row) of a community lane."""
    marked = items.withColumn("kept", keep_drop(F.col("category"), keep, drop) & fresh(F.col("ts"), last_run))
    signals = marked.filter("kept").drop("kept").withColumns({"source": F.lit(source), "origin": F.lit(source), "origin_source": F.lit(source)})
    return signals, marked.agg(F.lit(source).alias("source"), F.count("*").alias("pulled"), F.count_if("kept").alias("kept"))


def union_lanes(lanes: list[DataFrame]) -> DataFrame:
    """All lanes, columns that one lacks null."""
    out = lanes[0]
    for lane in lanes[1:]:
        out = out.unionByName(lane, allowMissingColumns=True)
    return out
