"""Feeds: the guard that rejects documents with a DOCTYPE, and timelines made from events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import fixed as K
from tidewatch.functions import scoring as S
from tidewatch.operators import origins
from tidewatch.plans.catalog import query, table
from tidewatch.sources import feeds
from tidewatch.sources.shared import shared_dir

PAGE = 4096


@query("SELECT page_id, regexp_matches(html, '(?i)^\\s*<!DOCTYPE') AS rejected FROM pages")
def q_doctype_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose prolog has a DOCTYPE."""
    return table(spark, sf_dir, "pages").select("page_id", feeds.has_doctype(F.col("html")).alias("rejected"))


@query("""
SELECT 'x.com/c' || user_id AS origin, count(*) AS n, round(sum(value), 4) AS faves FROM events JOIN customer ON c_custkey = user_id AND c_acctbal >= 0
WHERE ts >= '2024-01-10' AND value >= 5 AND (c_custkey % 2 = 1 OR event_type = 'purchase') GROUP BY ALL
""")
def q_timeline_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of rostered handles from raw timeline JSON that is made of events: freshness, engagement and topic filters.

    A page of a timeline holds the events of one user among PAGE consecutive ones, so no user makes a large row.
    """
    e = table(spark, sf_dir, "events")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    post = F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("text"), F.col("value").alias("likeCount"), stamp.alias("createdAt"))
    raw = e.groupBy("user_id", F.floor(F.col("event_id") / PAGE).alias("page")).agg(F.to_json(F.struct(F.collect_list(post).alias("tweets"))).alias("body"))
    responses = raw.select(F.concat(F.lit("@C"), "user_id").alias("handle"), "body", F.lit(0).alias("pos"))
    roster = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("handle"), F.col("c_mktsegment").alias("track"), F.lit(1).alias("tier"), (F.col("c_acctbal") >= 0).alias("enabled"),
        F.when(F.col("c_custkey") % 2 == 0, "purchase OR -spam").alias("topic_filter"),
    )
    signals, _ = feeds.collect_timelines(roster, responses, F.lit("2024-01-10").cast("timestamp"), 5)
    return signals.groupBy("origin").agg(F.count("*").alias("n"), F.round(F.sum("faves"), 4).alias("faves"))


@query("""
WITH r AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 1), p AS (SELECT user_id, value, event_id, CASE WHEN event_id % 5 = 0 THEN 'no-name' WHEN event_id % 4 = 1 THEN 'c' || user_id ELSE 'c' || event_id % 3001 END AS voice
  FROM events JOIN r ON k = user_id WHERE ts >= '2024-01-10' AND value >= 5 AND event_id % 3 = 0)
SELECT 'x.com/' || voice AS origin, 'c' || user_id AS via_handle, min('@C' || substr(voice, 2)) AS origin_handle, count(*) AS n, round(sum(value + 1), 4) AS faves, min('u/' || lpad(event_id::VARCHAR, 12, '0')) AS first_url
FROM p WHERE event_id % 5 <> 0 AND voice <> 'c' || user_id AND voice NOT IN (SELECT 'c' || k FROM r) GROUP BY ALL
""")
def q_quoted_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voices outside the roster that rostered handles quote, and who quoted them; a third of the posts quote somebody.

    Some quote themselves and some a name that is none; the roster is every second customer.
    """
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    voice = F.when(n % 5 == 0, "no-name").when(n % 4 == 1, F.concat(F.lit("@C"), "user_id")).otherwise(F.concat(F.lit("@C"), n % 3001))
    quoted = F.struct(F.concat(F.lit("u/"), F.lpad(n.cast("string"), 12, "0")).alias("url"), F.lit("q").alias("text"), (F.col("value") + 1).alias("likeCount"), stamp.alias("createdAt"), F.struct(voice.alias("userName")).alias("author"))
    post = F.struct(n.cast("string").alias("id"), F.lit("t").alias("text"), F.col("value").alias("likeCount"), stamp.alias("createdAt"), F.when(n % 3 == 0, quoted).alias("quoted_tweet"))
    raw = e.groupBy("user_id", F.floor(n / PAGE).alias("page")).agg(F.to_json(F.struct(F.collect_list(post).alias("tweets"))).alias("body"))
    responses = raw.select(F.concat(F.lit("@C"), "user_id").alias("handle"), "body", F.lit(0).alias("pos"))
    roster = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 1").select(F.concat(F.lit("c"), "c_custkey").alias("handle"), F.lit("t").alias("track"), F.lit(1).alias("tier"), F.lit(True).alias("enabled"), F.lit("").alias("topic_filter"))
    signals, _ = feeds.collect_timelines(roster, responses, F.lit("2024-01-10").cast("timestamp"), 5)
    voices = signals.filter("via_handle IS NOT NULL").groupBy("origin", "via_handle")
    return voices.agg(F.min("origin_handle").alias("origin_handle"), F.count("*").alias("n"), F.round(F.sum("faves"), 4).alias("faves"), F.min("url").alias("first_url"))


@query("""
SELECT event_id::VARCHAR AS run_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS source, CASE WHEN event_id % 3 <> 0 THEN user_id::INT END AS pulled, event_id % 11 = 0 AS first_of_file FROM events WHERE event_id % 7 NOT IN (1, 2, 3)
""")
def q_pull_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull lines read back from JSONL that is written from events: some are torn, some two records in one line, some blank, and some numbers are texts."""
    n = F.col("event_id")
    pulled = F.when(n % 3 != 0, F.col("user_id").cast("string")).otherwise(F.lit('"many"'))
    source = F.when(n % 4 == 0, "null").otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    line = F.concat(F.lit('{"run_id": "'), n, F.lit('", "handle": "'), F.when(n % 11 == 0, "first").otherwise(""), F.lit('", "source": '), source, F.lit(', "pulled": '), pulled, F.lit(', "new": [1]}'))
    torn = F.when(n % 7 == 1, F.expr("substr(line, 1, length(line) - 2)")).when(n % 7 == 2, F.concat("line", "line")).when(n % 7 == 3, " ").otherwise(F.concat(F.when(n % 11 == 0, "\ufeff").otherwise("  "), "line", F.lit("\r")))
    path = f"{shared_dir(spark)}/pull-lines-{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").withColumn("line", line).select(torn.alias("value")).write.text(path)
    return feeds.read_jsonl(spark, path, feeds.PULLS).select("run_id", "source", "pulled", (F.col("handle") == "first").alias("first_of_file"))


@query("""
SELECT 'order ' || o_orderkey AS title, lower(o_orderpriority) AS track, 2 AS n_entities, (o_orderkey % 101)::DOUBLE AS timing, 'http://o/' || o_custkey AS first_url FROM orders WHERE (o_orderkey // 2048) % 5 <> 2
""")
def q_candidate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates read back from many JSON files that are written from orders: lists, objects that hold one, and files cut short, which give nothing."""
    k = F.col("o_orderkey")
    item = F.struct(
        F.concat(F.lit("order "), k).alias("title"), F.lower("o_orderpriority").alias("track"), F.array(F.lit("a"), F.lit("b")).alias("entities"), F.struct((k % 101).alias("timing")).alias("score_breakdown"),
        F.array(F.struct(F.concat(F.lit("http://o/"), "o_custkey").alias("url"))).alias("evidence"), F.lit(1).alias("unknown"),
    )
    files = table(spark, sf_dir, "orders").groupBy(F.expr("o_orderkey div 2048").alias("file")).agg(F.to_json(F.collect_list(item)).alias("list"))
    held = F.when(F.col("file") % 5 == 1, F.concat(F.lit('{"run": 1, "candidates": '), "list", F.lit("}"))).when(F.col("file") % 5 == 2, F.expr("substr(list, 1, length(list) - 3)")).otherwise(F.col("list"))
    path = f"{shared_dir(spark)}/candidate-files-{uuid.uuid4().hex}"
    files.select("file", held.alias("value")).repartition("file").write.partitionBy("file").text(path)
    found = feeds.read_candidates(spark, f"{path}/*")
    return found.select("title", "track", F.size("entities").alias("n_entities"), "score_breakdown.timing", F.get("evidence", F.lit(0))["url"].alias("first_url"))


@query("""
SELECT 'forum' AS origin, event_type AS category, count(*) AS n, sum(user_id)::DOUBLE AS heat, NULL AS first_url FROM events WHERE ts >= '2024-01-10' AND event_type IN ('purchase', 'view') GROUP BY ALL
UNION ALL SELECT 'news', 'C' || page_id % 3, count(*), NULL, min(url) FROM pages WHERE page_id >= 12 AND page_id % 7 <> 0 AND page_id % 3 <> 1 GROUP BY ALL
""")
def q_community_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of two community lanes by category: a forum's JSON made of events, and RSS made of pages, some with a DOCTYPE."""
    e, p = table(spark, sf_dir, "events"), table(spark, sf_dir, "pages")
    topic = F.struct(
        F.col("event_id").alias("id"), F.lit("t").alias("title"), F.lit("").alias("url"), F.col("user_id").alias("replies"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("created"),
        F.struct(F.col("event_type").alias("name")).alias("node"),
    )
    forum = feeds.parse_topics(e.groupBy(F.floor(F.col("event_id") / PAGE)).agg(F.to_json(F.collect_list(topic)).alias("body")))
    hour = F.date_format(F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + F.col("page_id") * 3600), "EEE, dd MMM yyyy HH:mm:ss")
    prolog = F.when(F.col("page_id") % 7 == 0, "<!DOCTYPE rss>").otherwise("")
    link = F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    item = F.concat(F.lit("<item><title>t</title><link>"), link, F.lit("</link><category>C"), F.col("page_id") % 3, F.lit("</category><pubDate>"), hour, F.lit(" GMT</pubDate></item>"))
    news = feeds.parse_rss(p.select(F.concat(prolog, F.lit("<rss><channel>"), item, F.lit("</channel></rss>")).alias("body")))
    topics, _ = feeds.collect_community(forum, "forum", F.lit("2024-01-10").cast("timestamp"), keep=["Purchase", "view"])
    items, _ = feeds.collect_community(news, "news", F.lit("2024-01-01 12:00:00").cast("timestamp"), drop=["c1"])
    both = feeds.union_lanes([topics, items])
    return both.groupBy("origin", "category").agg(F.count("*").alias("n"), F.sum("heat").alias("heat"), F.min(F.nullif("url", F.lit(""))).alias("first_url"))


_FORUM = K.COMMUNITY_SOURCES[0]


@query(f"""
SELECT event_id, floor(age)::BIGINT AS age, CASE WHEN user_id % 3 >= {K.MIN_SOURCES} THEN 'card' WHEN event_id % 11 <> 0 AND event_id % 2 = 0 AND (event_type = 'view' OR event_id % 3 = 0) AND age <= {K.PULSE_MAX_AGE_H} THEN 'pulse' ELSE 'below_sources' END AS lane
FROM (SELECT *, greatest((epoch_us(TIMESTAMP '2024-01-08') - epoch_us(ts)) / 3.6e9::DOUBLE, 0) AS age FROM events)
""")
def q_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each event goes: a card with enough sources, else the rumour lane if it is fresh and of a community, else nowhere."""
    e = table(spark, sf_dir, "events")
    n, blank = F.col("event_id"), F.lit(None).cast("string")
    found = F.struct(F.when(F.col("event_type") == "view", _FORUM.upper()).alias("origin_source"), blank.alias("source"), F.when(n % 3 == 0, f" {_FORUM} ").alias("origin"))
    age = S.age_hours(F.col("ts").cast("timestamp"), F.lit("2024-01-08").cast("timestamp"))
    eligible = origins.pulse_eligible(n % 11 == 0, n % 2 == 0, origins.is_community(found), age)
    return e.select("event_id", F.floor(age).alias("age"), origins.lane(F.col("user_id") % 3, eligible).alias("lane"))
