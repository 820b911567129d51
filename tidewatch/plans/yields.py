"""Yield of event users: views are pulls, purchases contributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import aliases
from tidewatch.functions import text as T
from tidewatch.operators import dedup, rings, yields
from tidewatch.plans.catalog import query, table


def day(text: str):
    return F.lit(text).cast("timestamp")


NOW, START = "2024-01-31", "2024-01-01"
LATE = "2024-01-30"  # pulls count from here in the ratio, so that some users have none


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def pulls(e: DataFrame) -> DataFrame:
    return e.filter("event_type = 'view'").select(F.lit("handle").alias("kind"), F.col("user_id").alias("name"), "ts", F.lit(1).alias("kept"))


def evidence(e: DataFrame) -> DataFrame:
    """Purchases; two event ids in a row are one opportunity, so some collapse."""
    return e.filter("event_type = 'purchase'").select(
        F.floor(F.col("event_id") / 2).alias("opp_id"), "ts", F.lit("handle").alias("kind"), F.col("user_id").alias("name"), (F.col("value") > 80).alias("pushed"), F.col("value").alias("faves"), (F.col("event_id") % 3).cast("string").alias("track")
    )


_EV = "SELECT event_id // 2 AS opp_id, ts, user_id AS name, value > 80 AS pushed, value, event_id % 3 AS track FROM events WHERE event_type = 'purchase'"


@query(f"""
WITH ev AS ({_EV}), o AS (SELECT opp_id, bool_or(pushed) AS pushed FROM ev GROUP BY ALL), e AS (SELECT opp_id, name, bool_or(value < 500) AS early FROM ev GROUP BY ALL),
n AS (SELECT name, count(*) AS contributions, count(*) FILTER (WHERE pushed) AS pushed, count(*) FILTER (WHERE early) AS pre_viral FROM e JOIN o USING (opp_id) GROUP BY ALL),
d AS (SELECT user_id AS name, count(*) AS pulls FROM events WHERE event_type = 'view' AND ts >= '2024-01-30' GROUP BY ALL)
SELECT coalesce(n.name, d.name) AS name, coalesce(contributions, 0) AS contributions, coalesce(pushed, 0) AS pushed, coalesce(pre_viral, 0) AS pre_viral, coalesce(pulls, 0) AS pulls, round(coalesce(contributions, 0) / nullif(pulls, 0), 6) AS yield
FROM n FULL JOIN d ON n.name = d.name
""")
def q_yield_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions over pulls of each user; null where nothing was pulled in the last day."""
    e = events(spark, sf_dir)
    up, down = yields.numerator(evidence(e), day(START), day(NOW)), yields.denominator(pulls(e), day(LATE), day(NOW))
    return yields.ratios(up, down).select("name", "contributions", "pushed", "pre_viral", "pulls", "yield")


_WEEK = "CAST(floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts) - 1) / 604800000000) AS INTEGER)"
_WEEKLY = f"""SELECT n.name, w.week, coalesce(p.pulls, 0) AS pulls, coalesce(c.contributions, 0) AS contributions FROM (SELECT DISTINCT user_id AS name FROM events WHERE event_type = 'view') n CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS week) w
LEFT JOIN (SELECT user_id AS name, {_WEEK} AS week, count(*) AS pulls FROM events WHERE event_type = 'view' GROUP BY ALL) p ON p.name = n.name AND p.week = w.week
LEFT JOIN (SELECT name, {_WEEK} AS week, count(DISTINCT opp_id) AS contributions FROM ({_EV}) GROUP BY ALL) c ON c.name = n.name AND c.week = w.week"""


@query(_WEEKLY)
def q_yield_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pulls and contributions by trailing week."""
    e = events(spark, sf_dir)
    return yields.weekly(pulls(e), evidence(e), day(NOW), 4)


@query(f"""
WITH w AS ({_WEEKLY}), dead AS (SELECT name FROM w WHERE week < 2 GROUP BY name HAVING bool_and(pulls >= 1 AND contributions <= 1)),
spared AS (SELECT user_id AS name FROM events WHERE event_type = 'purchase' AND value < 1 GROUP BY ALL)
SELECT c_custkey AS name, c_mktsegment AS track FROM customer WHERE c_acctbal >= 0 AND c_custkey IN (SELECT name FROM dead) AND c_custkey NOT IN (SELECT name FROM spared)
""")
def q_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enabled customers whose pulls brought at most one opportunity in each of two weeks, but those with an early find."""
    e = events(spark, sf_dir)
    roster = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), F.col("c_mktsegment").alias("track"), (F.col("c_acctbal") >= 0).alias("enabled"))
    spared = e.filter("event_type = 'purchase' AND value < 1").select(F.col("user_id").alias("name")).distinct()
    return yields.prune(roster, yields.weekly(pulls(e), evidence(e), day(NOW), 2), spared, 1).select("name", "track")


@query(f"""
SELECT name, count(DISTINCT opp_id) AS n_opps, array_to_string(list_sort(list(DISTINCT track::VARCHAR)), ',') AS tracks FROM ({_EV})
WHERE name NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY name HAVING count(DISTINCT opp_id) >= 2
""")
def q_propose_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users outside the roster (customers of one segment) with two or more opportunities."""
    roster = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("name"))
    return yields.propose(evidence(events(spark, sf_dir)), roster).drop("sample_url")


@query("""
SELECT user_id AS name, count(DISTINCT event_id // 2) AS n_opps, arg_min('http://u/' || event_id % 1000, event_id) FILTER (WHERE event_id % 3 <> 0) AS sample_url FROM events
WHERE event_type = 'purchase' AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY ALL HAVING count(DISTINCT event_id // 2) >= 2
""")
def q_propose_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users outside the roster with the first address of their evidence that is not blank."""
    e = events(spark, sf_dir).filter("event_type = 'purchase'")
    url = F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.concat(F.lit("http://u/"), F.col("event_id") % 1000))
    found = e.select(F.expr("event_id div 2").alias("opp_id"), F.col("user_id").alias("name"), F.lit("t").alias("track"), F.col("event_id").alias("pos"), url.alias("url"))
    roster = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("name"))
    return yields.propose(found, roster).select("name", "n_opps", "sample_url")


@query("SELECT round((epoch_us(TIMESTAMP '2024-01-31') - min(epoch_us(ts))) / 86400000000, 6) AS days FROM events WHERE event_type = 'purchase'")
def q_history_of_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of history where no pull has a time: the records tell."""
    e = events(spark, sf_dir)
    return yields.history_days(pulls(e).withColumn("ts", F.lit(None).cast("timestamp")), evidence(e), day(NOW)).select(F.round("days", 6).alias("days"))


@query(f"""
WITH n AS (SELECT name, count(DISTINCT opp_id) AS contributions FROM ({_EV}) GROUP BY ALL), d AS (SELECT user_id AS name, count(*) AS pulls FROM events WHERE event_type <> 'purchase' GROUP BY ALL)
SELECT name, contributions, pulls, round(contributions / pulls, 6) AS yield FROM n JOIN d USING (name) JOIN customer ON c_custkey = name
WHERE c_custkey % 2 = 1 AND pulls >= 10 AND contributions >= 1 AND round(contributions / pulls, 6) < 0.1
""")
def q_suggest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Often pulled users (any event but a purchase) that contribute rarely and have no filter."""
    e = events(spark, sf_dir)
    down = e.filter("event_type <> 'purchase'").select(F.lit("handle").alias("kind"), F.col("user_id").alias("name"), "ts", F.lit(1).alias("kept"))
    ratio = yields.ratios(yields.numerator(evidence(e), day(START), day(NOW)), yields.denominator(down, day(START), day(NOW)))
    roster = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "ai").alias("topic_filter"))
    return yields.suggest_filters(ratio, roster).select("name", "contributions", "pulls", "yield")


@query("SELECT user_id AS name, count(*) AS n, count(*) FILTER (WHERE value < 5) AS n_early, bool_or(value < 5) AS pre_viral FROM events WHERE event_type = 'purchase' GROUP BY ALL")
def q_pre_viral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with a find of little engagement yet, which goes by one of six names in a variant, as a number or as a text."""
    e = events(spark, sf_dir).filter("event_type = 'purchase'")
    name = F.element_at(F.array(*[F.lit(n) for n in aliases.ENGAGEMENT]), (F.col("event_id") % 6 + 1).cast("int"))
    mark = F.when(F.col("event_id") % 2 == 0, '"').otherwise("")
    held = F.parse_json(F.concat(F.lit('{"'), name, F.lit('": '), mark, F.col("value").cast("string"), mark, F.lit(', "other": 0}')))
    early = aliases.any_below(held, aliases.ENGAGEMENT, 5)
    return e.withColumn("early", early).groupBy(F.col("user_id").alias("name")).agg(F.count("*").alias("n"), F.count_if("early").alias("n_early"), F.bool_or("early").alias("pre_viral"))


@query("""
SELECT c_name AS name, CASE WHEN c_custkey % 7 = 0 OR c_acctbal < 0 THEN 'dead' ELSE 'drift' END AS flag FROM customer
WHERE c_custkey % 3 <> 0 AND (c_custkey % 7 = 0 OR c_acctbal < 0 OR c_custkey % 5 = 0)
""")
def q_drift_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of an identity sweep: a third of the customers were not swept, a seventh not found, a fifth renamed."""
    c = table(spark, sf_dir, "customer")
    roster = c.select(F.col("c_name").alias("name"))
    sweep = c.filter("c_custkey % 3 <> 0").select(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 7 != 0, F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit("x"))).otherwise(F.upper("c_name"))).alias("found_name"), F.when(F.col("c_acctbal") >= 0, 1).otherwise(0).alias("posts"))
    return yields.identity_flags(roster, sweep)


@query("SELECT round((epoch_us(TIMESTAMP '2024-01-31') - min(epoch_us(ts)) FILTER (WHERE event_type = 'view')) / 86400000000, 6) AS days, count(*) FILTER (WHERE event_type = 'view') AS n_pulls, sum(CASE WHEN event_type = 'view' THEN event_id % 4 ELSE 0 END)::BIGINT AS kept FROM events")
def q_history_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of history, pulls and what they kept."""
    e = events(spark, sf_dir)
    p = e.filter("event_type = 'view'").select(F.lit("handle").alias("kind"), F.lit("all").alias("name"), "ts", (F.col("event_id") % 4).alias("kept"))
    span = yields.history_days(p, evidence(e), day(NOW)).select(F.round("days", 6).alias("days"))
    return span.crossJoin(yields.denominator(p, day("1970-01-01"), day("2100-01-01")).select(F.col("pulls").alias("n_pulls"), "kept"))  # one row each


@query("""
SELECT user_id AS name, strftime(d, '%Y-%m-%d') AS day FROM (SELECT user_id, max(ts)::DATE AS last FROM events WHERE event_id % 17 = 0 GROUP BY ALL)
CROSS JOIN LATERAL (SELECT unnest(generate_series(greatest(last + 1, DATE '2024-01-31' - 6)::TIMESTAMP, TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS d)
""")
def q_missed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days since each user's last digest (every seventeenth event), the newest seven."""
    last = events(spark, sf_dir).filter("event_id % 17 = 0").groupBy("user_id").agg(F.to_date(F.max("ts")).alias("last"))
    days = F.explode(yields.missed_dates(F.col("last"), F.to_date(day(NOW)), 7))
    return last.select(F.col("user_id").alias("name"), days.alias("d")).select("name", F.date_format("d", "yyyy-MM-dd").alias("day"))


_SECTIONS = f"""
WITH ev AS ({_EV}), dead AS (SELECT name FROM ({_WEEKLY}) WHERE week < 2 GROUP BY name HAVING bool_and(pulls >= 1 AND contributions <= 1)),
p AS (SELECT c_custkey AS name FROM customer WHERE c_acctbal >= 0 AND c_custkey IN (SELECT name FROM dead) AND c_custkey NOT IN (SELECT name FROM ev WHERE value < 1)),
n AS (SELECT name, count(DISTINCT opp_id) AS c FROM ev GROUP BY ALL), d AS (SELECT user_id AS name, count(*) AS pulls FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT 'prune' AS section, name::VARCHAR AS name FROM p UNION ALL SELECT 'disabled', name::VARCHAR FROM p UNION ALL SELECT 'disabled', c_custkey::VARCHAR FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'propose_add', name::VARCHAR FROM n WHERE c >= 2 AND name NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'suggest_filters', name::VARCHAR FROM n JOIN d USING (name) JOIN customer ON c_custkey = name WHERE c_custkey % 2 = 1 AND pulls >= 10 AND round(c / pulls, 6) < 0.1
UNION ALL SELECT 'dead', c_custkey::VARCHAR FROM customer WHERE c_custkey % 7 = 0"""


@query(_SECTIONS)
def q_yield_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly report with its pruning applied; a seventh of the customers were swept and not found."""
    e, key = events(spark, sf_dir), F.col("c_custkey")
    roster = table(spark, sf_dir, "customer").select(key.alias("name"), (F.col("c_acctbal") >= 0).alias("enabled"), F.when(key % 2 == 0, "ai").alias("topic_filter"))
    sweep = roster.filter("name % 7 = 0").select("name", F.lit(None).cast("string").alias("found_name"), F.lit(0).alias("posts"))
    return yields.report(roster, evidence(e), pulls(e), day(NOW), sweep, apply=True, floor=1, pre_viral=1)


@query("SELECT isoyear(ts)::VARCHAR || '-W' || lpad(week(ts)::VARCHAR, 2, '0') AS label, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS at FROM events GROUP BY ALL")
def q_run_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One marker for each ISO week, however often its run is repeated; all runs come after those of half a month."""
    runs = events(spark, sf_dir).select(T.iso_week(F.col("ts")).alias("label"), F.col("ts").alias("at"))
    early = yields.marked_once(runs.limit(0), runs.filter(F.col("at") < day("2024-01-16")))
    return yields.marked_once(early, runs).select("label", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT isoyear(ts)::VARCHAR || '-W' || lpad(week(ts)::VARCHAR, 2, '0') AS iso_week, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def q_iso_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by ISO week."""
    return events(spark, sf_dir).groupBy(T.iso_week(F.col("ts")).alias("iso_week")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("""
SELECT user_id AS name, count(*) AS n, min(event_id) AS oldest, max(event_id) AS newest, round(sum(value), 4) AS total FROM
(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 30 GROUP BY ALL
""")
def q_ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last thirty samples of each user."""
    e = events(spark, sf_dir).withColumnRenamed("user_id", "name")
    early, late = e.filter(F.col("ts") < day("2024-01-20")), e.filter(F.col("ts") >= day("2024-01-20"))
    rings_of = lambda df: rings.ring_buffer(df, "name", ["ts", "event_id"], ["value"])
    held = rings.merge_rings(rings_of(early), rings_of(late), "name")
    total = F.aggregate("samples", F.lit(0.0), lambda acc, s: acc + s["value"])
    return held.select("name", F.size("samples").cast("long").alias("n"), F.array_min("samples.event_id").alias("oldest"), F.array_max("samples.event_id").alias("newest"), F.round(total, 4).alias("total"))


@query("""
SELECT user_id AS name, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, round(arg_max(value, {'t': ts, 'v': value}), 4) AS last_score,
count(*) FILTER (WHERE event_type = 'purchase') AS push_count, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS source_set FROM events GROUP BY ALL
""")
def q_upsert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger state of each user after two batches are merged: the first half of the month, then the rest."""
    e = events(spark, sf_dir).select(
        F.col("user_id").alias("canonical_key"), F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"), F.col("value").alias("last_score"), F.lit("").alias("lifecycle_stage"),
        (F.col("event_type") == "purchase").cast("long").alias("push_count"), F.array("event_type").alias("source_set"),
    )
    half = F.lit("2024-01-16").cast("timestamp")
    old, new = e.filter(F.col("first_seen") < half), e.filter(F.col("first_seen") >= half)
    out = dedup.upsert(dedup.upsert(old.limit(0), old), new)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.select(F.col("canonical_key").alias("name"), text("first_seen").alias("first_seen"), text("last_seen").alias("last_seen"), F.round("last_score", 4).alias("last_score"), "push_count", F.array_join("source_set", ",").alias("source_set"))


@query("SELECT user_id AS name, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_shown FROM events WHERE event_id % 29 = 0 GROUP BY ALL HAVING max(ts) >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY")
def q_seen_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was shown within the retention time."""
    from tidewatch.operators import pulse

    shown = events(spark, sf_dir).filter("event_id % 29 = 0").select(F.col("user_id").alias("pulse_key"), F.col("ts").alias("last_shown"))
    out = pulse.merge_seen(shown, shown.limit(0), day(NOW))
    return out.select(F.col("pulse_key").alias("name"), F.date_format("last_shown", "yyyy-MM-dd HH:mm:ss").alias("last_shown"))


@query("""
WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND ts < '2024-01-05'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND ts >= '2024-01-27')
SELECT coalesce(a.user_id, b.user_id) AS name, a.user_id IS NOT NULL AND b.user_id IS NOT NULL AS in_both, a.user_id IS NULL AS only_new, b.user_id IS NULL AS only_old FROM a FULL JOIN b ON a.user_id = b.user_id
""")
def q_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection, differences and symmetric difference of two user sets, in one full outer join."""
    e = events(spark, sf_dir)
    old = e.filter((F.col("event_type") == "purchase") & (F.col("ts") < day("2024-01-05"))).select(F.col("user_id").alias("name"))
    new = e.filter((F.col("event_type") == "click") & (F.col("ts") >= day("2024-01-27"))).select(F.col("user_id").alias("name"))
    return yields.sets_compared(old, new)


@query("SELECT event_type, (props->>'$.k')::BIGINT % 10 AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a JSON column, with a schema."""
    e = events(spark, sf_dir).withColumn("k", F.from_json("props", "k bigint")["k"] % 10)
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
