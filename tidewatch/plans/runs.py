"""Runs and their state: exemptions, replays, shards, the ledger's table, lanes, late rows and the pulse stream, over events and customers."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import aliases
from tidewatch.operators import grants, privacy, replay
from tidewatch.plans.catalog import query, table
from tidewatch.plans.yields import _EV, events, evidence, pulls
from tidewatch.sources import binaries, ledger, shards
from tidewatch.sources.shared import shared_dir
from tidewatch.streaming import lanes, pulse, state
from tidewatch.streaming.keyvalue import StateTable

UTC = dt.timezone.utc


def place(spark: SparkSession, name: str) -> str:
    """A folder of a run's own."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- exemptions

_FINDINGS = "SELECT event_id AS finding, 'T' || user_id % 40 AS token, CASE event_type WHEN 'view' THEN 'history' WHEN 'error' THEN 'staged' ELSE 'tree' END AS domain, 'r' || event_id % 3 AS repo, 'a' || event_id % 4 || '/b' || event_id % 5 || '/f.txt' AS path, ts FROM events"
_GRANTS = "SELECT c_custkey AS pos, 't' || c_custkey % 40 AS token, CASE WHEN c_custkey % 3 = 0 THEN 'all' ELSE 'history-only' END AS scope, CASE WHEN c_custkey % 2 = 0 THEN 'r' || c_custkey % 5 END AS repo, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a' || c_custkey % 7 WHEN 2 THEN 'a' || c_custkey % 7 || '/b' || c_custkey % 6 || '/' ELSE '' END AS prefix, CASE WHEN c_acctbal < 2000 THEN TIMESTAMP '2024-01-15' END AS expires FROM customer WHERE c_nationkey < 5"
_COVER = f"""f AS ({_FINDINGS}), g AS ({_GRANTS}),
m AS (SELECT finding, pos, scope = 'all' OR domain = 'history' AS applies, row_number() OVER (PARTITION BY finding ORDER BY g.repo IS NULL, -len(list_filter(string_split(rtrim(coalesce(prefix, ''), '/'), '/'), lambda x: x <> '')), pos) AS rank
  FROM f JOIN g ON lower(f.token) = g.token AND (g.repo IS NULL OR g.repo = f.repo) AND (coalesce(prefix, '') = '' OR starts_with(f.path, rtrim(prefix, '/') || '/')) AND (expires IS NULL OR f.ts < expires)),
b AS (SELECT finding, min(rank) FILTER (WHERE applies) AS best FROM m GROUP BY ALL)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = events(spark, sf_dir), F.col("event_id")
    domain = F.when(F.col("event_type") == "view", "history").when(F.col("event_type") == "error", "staged").otherwise("tree")
    path = F.format_string("a%d/b%d/f.txt", n % 4, n % 5)
    return e.select(n.alias("finding"), F.concat(F.lit("T"), F.col("user_id") % 40).alias("token"), domain.alias("domain"), F.concat(F.lit("r"), n % 3).alias("repo"), path.alias("path"), F.col("ts").alias("at"))


def exemptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer").filter("c_nationkey < 5"), F.col("c_custkey")
    prefix = F.when(n % 4 == 1, F.concat(F.lit("a"), n % 7)).when(n % 4 == 2, F.format_string("a%d/b%d/", n % 7, n % 6)).when(n % 4 == 3, "")
    return c.select(
        n.alias("pos"), F.concat(F.lit("t"), n % 40).alias("token"), F.when(n % 3 == 0, "all").otherwise("history-only").alias("scope"), F.when(n % 2 == 0, F.concat(F.lit("r"), n % 5)).alias("repo"), prefix.alias("prefix"),
        F.when(F.col("c_acctbal") < 2000, F.lit("2024-01-15").cast("timestamp")).alias("expires"),
    )


@query(f"WITH {_COVER} SELECT f.finding, m.pos AS grant_pos FROM f LEFT JOIN b USING (finding) LEFT JOIN m ON m.finding = b.finding AND m.rank = b.best")
def q_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exemption that suppresses each finding: events are findings, customers of five nations are grants."""
    return grants.granted(findings(spark, sf_dir), exemptions(spark, sf_dir)).select("finding", "grant_pos")


@query(f"""
WITH {_COVER}, u AS (SELECT pos, count(*) FILTER (WHERE applies AND rank = best) AS suppressed, count(*) FILTER (WHERE NOT applies AND (best IS NULL OR rank < best)) AS live_collisions FROM m JOIN b USING (finding) GROUP BY ALL),
t AS (SELECT g.pos, coalesce(suppressed, 0) AS s, coalesce(live_collisions, 0) AS l FROM g LEFT JOIN u USING (pos))
SELECT count(*) AS declared, count(*) FILTER (WHERE s > 0) AS used, count(*) FILTER (WHERE s = 0) AS never_fired, count(*) FILTER (WHERE l > 0) AS collided, sum(l)::BIGINT AS collisions FROM t""")
def q_grant_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared, used and unused exemptions, and those of the past that live text runs into."""
    return grants.grant_receipt(findings(spark, sf_dir), exemptions(spark, sf_dir))


_REPOS = "SELECT lower(p_brand) AS owner, replace(p_name, ' ', '-') || CASE p_partkey % 5 WHEN 0 THEN '-config' WHEN 1 THEN '-data' WHEN 2 THEN '_one-two' ELSE '' END AS name, p_size > 25 AS private FROM part"


@query(f"""
WITH r AS ({_REPOS}), n AS (SELECT DISTINCT owner, name FROM r WHERE private AND length(name) >= 5 AND (regexp_matches(name, '-(config|data|private|secrets)$') OR length(regexp_replace(name, '[^-_]', '', 'g')) >= 2)
  AND name NOT IN ('red-widget', 'red-widget-config', 'red-widget-data', 'red-widget-private', 'red-widget-secrets')),
w AS (SELECT n.owner, n.name, CASE WHEN regexp_matches(n.name, '-(config|data|private|secrets)$') AND EXISTS (FROM r p WHERE NOT p.private AND p.owner = n.owner AND p.name = regexp_replace(n.name, '-(config|data|private|secrets)$', '')) THEN regexp_replace(n.name, '-(config|data|private|secrets)$', '') END AS witness FROM n)
SELECT name AS token, CASE WHEN witness IS NULL THEN 'linkage' ELSE 'derived' END AS kind, owner, witness FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY witness IS NOT NULL, owner, witness) AS rn FROM w) WHERE rn = 1""")
def q_cross_repo_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private names that would give something away: brands own, parts are repositories, red-widget is our own."""
    p, n = table(spark, sf_dir, "part"), F.col("p_partkey") % 5
    end = F.when(n == 0, "-config").when(n == 1, "-data").when(n == 2, "_one-two").otherwise("")
    repos = p.select(F.lower("p_brand").alias("owner"), F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), end).alias("name"), (F.col("p_size") > 25).alias("private"))
    return privacy.cross_repo_tokens(repos, "red-widget", 3)


# ---------------------------------------------------------------- replay

_TIMES = "(SELECT unnest(generate_series(TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-29', INTERVAL 7 DAY)) AS checkpoint)"
TIMES = ("2024-01-08", "2024-01-29")
_SEEN = "ts < checkpoint AND ts >= checkpoint - INTERVAL {} DAY"


@query(f"""
WITH u AS (SELECT checkpoint, name, count(DISTINCT opp_id) AS c FROM ({_EV}), {_TIMES} WHERE {_SEEN.format(10)} GROUP BY ALL), d AS (SELECT checkpoint, user_id AS name, count(*) AS p FROM events, {_TIMES} WHERE event_type = 'view' AND {_SEEN.format(10)} GROUP BY ALL)
SELECT strftime(checkpoint, '%Y-%m-%d') AS checkpoint, name, coalesce(c, 0) AS contributions, coalesce(p, 0) AS pulls, round(coalesce(c, 0) / nullif(p, 0), 6) AS yield FROM u FULL JOIN d USING (checkpoint, name)""")
def q_replay_yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yields as four weekly runs would have reported them, of ten days each."""
    e = events(spark, sf_dir)
    found = replay.replay_yields(evidence(e), pulls(e), replay.checkpoints(*TIMES), 10)
    return found.select(F.date_format("checkpoint", "yyyy-MM-dd").alias("checkpoint"), "name", "contributions", "pulls", "yield")


@query(f"""
WITH w AS (SELECT checkpoint, week, user_id AS name, count(*) AS p FROM (SELECT *, floor((epoch_us(checkpoint) - epoch_us(ts) - 1) / 604800000000) AS week FROM events, {_TIMES} WHERE event_type = 'view' AND {_SEEN.format(14)}) GROUP BY ALL),
c AS (SELECT checkpoint, week, name, count(DISTINCT opp_id) AS c FROM (SELECT *, floor((epoch_us(checkpoint) - epoch_us(ts) - 1) / 604800000000) AS week FROM ({_EV}), {_TIMES} WHERE {_SEEN.format(14)}) GROUP BY ALL),
d AS (SELECT checkpoint, name FROM w LEFT JOIN c USING (checkpoint, week, name) WHERE coalesce(c, 0) <= 2 GROUP BY ALL HAVING count(*) = 2),
s AS (SELECT DISTINCT checkpoint, name FROM ({_EV}), {_TIMES} WHERE value < 1 AND {_SEEN.format(30)})
SELECT name, strftime(min(checkpoint), '%Y-%m-%d') AS disabled_at FROM d JOIN customer ON c_custkey = name WHERE c_acctbal >= 0 AND (checkpoint, name) NOT IN (FROM s) GROUP BY ALL""")
def q_replay_prunes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When weekly runs that prune would have disabled each customer."""
    e = events(spark, sf_dir)
    roster = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), (F.col("c_acctbal") >= 0).alias("enabled"))
    found = replay.replay_prunes(roster, evidence(e), pulls(e), replay.checkpoints(*TIMES), 2, 2, 1)
    return found.select("name", F.date_format("disabled_at", "yyyy-MM-dd").alias("disabled_at"))


@query(f"""SELECT strftime(checkpoint, '%Y-%m-%d') AS checkpoint, user_id AS name, arg_max(event_type, {{'t': ts, 'e': event_type, 'v': value}}) AS event_type, arg_max(value, {{'t': ts, 'e': event_type, 'v': value}}) AS value
FROM events, {_TIMES} WHERE ts <= checkpoint GROUP BY ALL""")
def q_last_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event as of four checkpoints."""
    found = replay.last_known(events(spark, sf_dir).withColumnRenamed("user_id", "name"), "name", "ts", replay.checkpoints(*TIMES), ["event_type", "value"])
    return found.withColumn("checkpoint", F.date_format("checkpoint", "yyyy-MM-dd"))


# ---------------------------------------------------------------- sources


@query("SELECT strftime(t, '%Y-%m') AS ym, count(*) AS n, sum(event_id)::BIGINT AS total FROM (SELECT event_id, ts + to_days((event_id % 5 * 31)::INTEGER) AS t FROM events) WHERE t >= '2024-02-10' AND t < '2024-04-03' GROUP BY ALL")
def q_month_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events spread over five months of shards, of which a window opens three."""
    folder, n = place(spark, "shards"), F.col("event_id")
    spread = events(spark, sf_dir).select(n.cast("string").alias("run_id"), (F.col("ts") + F.make_dt_interval((n % 5 * 31).cast("int"))).alias("ts"))
    shards.write_shards(spread, folder)
    found = shards.read_window(spark, folder, dt.datetime(2024, 2, 10, tzinfo=UTC), dt.datetime(2024, 4, 3, tzinfo=UTC))
    return found.groupBy("ym").agg(F.count("*").alias("n"), F.sum(F.col("run_id").cast("long")).alias("total"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN round(value, 2) WHEN 1 THEN event_id::DOUBLE WHEN 2 THEN 0.0 ELSE 7.0 END AS faves FROM events")
def q_alias_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likes under the first of their names that holds a number: a text and a boolean before it are passed over."""
    n, v = F.col("event_id"), F.round("value", 2).cast("string")
    body = (
        F.when(n % 4 == 0, F.concat(F.lit('{"likes": 3, "likeCount": '), v, F.lit("}")))
        .when(n % 4 == 1, F.concat(F.lit('{"likeCount": true, "favoriteCount": "9", "like_count": '), n.cast("string"), F.lit("}")))
        .when(n % 4 == 2, F.concat(F.lit('{"likeCount": "'), v, F.lit('"}')))
        .otherwise(F.lit('{"likes": 7, "favorite_count": 1, "likeCount": null}'))
    )
    return events(spark, sf_dir).select("event_id", aliases.first_number(F.parse_json(body), aliases.FAVES).alias("faves"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16' WHEN 2 THEN 'utf-8' END AS encoding, CASE WHEN doc_id % 4 < 3 THEN md5(text) END AS text_md5 FROM documents WHERE length(text) > 0""")
def q_decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts back from bytes of unknown encoding; a quarter are UTF-16 with a byte order mark, a quarter no text at all."""
    d, n = table(spark, sf_dir, "documents").filter(F.length("text") > 0), F.col("doc_id") % 4
    noise = F.unhex(F.concat(F.lit("89504E470D0A1A0A00FF"), F.hex(F.encode(F.md5("text"), "UTF-8")), F.lit("00FE01")))
    data = F.when(n == 1, F.encode("text", "UTF-16")).when(n == 3, noise).otherwise(F.encode("text", "UTF-8"))
    got = d.select("doc_id", binaries.decode(data).alias("d"))
    return got.select("doc_id", "d.encoding", F.md5("d.text").alias("text_md5"))


# ---------------------------------------------------------------- state and streams


@query("SELECT event_type AS key, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY ALL")
def q_state_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few named values, changed by two writers of a state table in turn, and read back as one snapshot."""
    halves = [events(spark, sf_dir).filter(f"event_id % 2 = {i}") for i in (0, 1)]
    path = place(spark, "state")
    for part in halves:
        rows = part.groupBy("event_type").agg(F.count("*").alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last")).collect()  # a row an event type

        def change(values: dict, rows=rows) -> dict:
            for key, n, last in rows:
                old = values.get(key, {"n": 0, "last": ""})
                values[key] = {"n": old["n"] + n, "last": max(old["last"], last)}
            return values

        StateTable(spark, path).update(change)
    values = StateTable(spark, path).snapshot()[1]
    return spark.createDataFrame([(k, v["n"], v["last"]) for k, v in sorted(values.items())], "key string, n long, last string")


@query("""SELECT 'views' AS lane, count(*) AS n FROM events WHERE event_type = 'view' AND ts < '2024-01-20' UNION ALL SELECT 'clicks', count(*) FROM events WHERE event_type = 'click' AND ts < '2024-01-20'
UNION ALL SELECT 'watermark', epoch(TIMESTAMP '2024-01-20')::BIGINT""")
def q_lane_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs of two lanes; in the second one lane fails, so the watermark waits and the third covers its time. Each row counts once."""
    e, runs = events(spark, sf_dir), lanes.LaneRuns(spark, place(spark, "lanes"))

    def lane(kind: str, until: dt.datetime, broken: bool = False):
        def read(since: dt.datetime | None) -> DataFrame:
            if broken:
                raise OSError("no answer")
            own = e.filter((F.col("event_type") == kind) & (F.col("ts") < F.lit(until)))
            return own.filter(F.col("ts") >= F.lit(since)) if since else own

        return read

    for i, (day, broken) in enumerate(((10, False), (15, True), (20, False))):
        until = dt.datetime(2024, 1, day, tzinfo=UTC)
        runs.run(f"r{i}", until, {"views": lane("view", until), "clicks": lane("click", until, broken)})
    counts = [runs.table(name).agg(F.lit(name).alias("lane"), F.count_distinct("event_id").alias("n")) for name in ("views", "clicks")]
    mark = spark.createDataFrame([("watermark", int(runs.watermark().timestamp()))], "lane string, n long")
    return counts[0].unionByName(counts[1]).unionByName(mark)


@query("SELECT CASE WHEN ts < '2024-01-12' THEN 'late' ELSE 'on_time' END AS \"when\", count(*) AS n, sum(event_id)::BIGINT AS total FROM events GROUP BY ALL")
def q_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream after a run of January the 12th: what lies before it is kept apart."""
    src, out = place(spark, "late-source"), place(spark, "late")
    events(spark, sf_dir).write.parquet(src)
    runs = lanes.LaneRuns(spark, f"{out}/runs")
    runs.run("first", dt.datetime(2024, 1, 12, tzinfo=UTC), {})
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 64).parquet(src)
    state.run_available(stream, lanes.late_writer(runs, f"{out}/rows"), f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows").groupBy("when").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


@query("""
SELECT 'u' || user_id AS canonical_key, arg_max('c' || event_id % 7, {'t': ts, 'c': 'c' || event_id % 7}) FILTER (WHERE event_id % 3 = 0) AS cluster_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen,
round(arg_max(value, {'t': ts, 'v': value}), 4) AS last_score, count(*) FILTER (WHERE event_type = 'purchase') AS push_count, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS source_set, least(count(*), 30) AS n_samples,
(SELECT round(sum(value), 4) FROM (SELECT value FROM events i WHERE i.user_id = o.user_id ORDER BY ts DESC, value DESC LIMIT 30)) AS samples_total FROM events o GROUP BY user_id""")
def q_ledger_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bucketed ledger after three batches of events, the second one sent twice."""
    e, n = events(spark, sf_dir), F.col("event_id")
    score, when = F.col("value").cast("double"), F.col("ts")
    rows = e.select(
        F.concat(F.lit("u"), "user_id").alias("canonical_key"), F.lit("op").alias("opportunity_id"), F.when(n % 3 == 0, F.concat(F.lit("c"), n % 7)).alias("cluster_id"), F.lit(None).cast("timestamp").alias("cluster_at"), when.alias("first_seen"), when.alias("last_seen"), score.alias("last_score"),
        F.lit("").alias("lifecycle_stage"), (F.col("event_type") == "purchase").cast("long").alias("push_count"), F.array("event_type").alias("source_set"), F.lit(0).cast("long").alias("simhash"), F.col("event_type").alias("text"), F.array("event_type").alias("toks"),
        F.array(F.struct(when.alias("ts"), score.alias("score"), F.col("event_type").alias("source"))).alias("samples"),
    )
    book = ledger.Ledger(spark, place(spark, "ledger"), buckets=16)
    for number, part in ((0, 0), (1, 1), (1, 1), (2, 2)):
        book.merge(rows.filter(F.pmod(F.xxhash64("last_seen", "last_score"), F.lit(3)) == part), number)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    total = F.round(F.aggregate("samples", F.lit(0.0), lambda acc, s: acc + s["score"]), 4)
    return book.rows().select("canonical_key", F.nullif("cluster_id", F.lit("")).alias("cluster_id"), text("first_seen"), text("last_seen"), F.round("last_score", 4).alias("last_score"), "push_count", F.array_join("source_set", ",").alias("source_set"), F.size("samples").cast("long").alias("n_samples"), total.alias("samples_total"))


@query("""
WITH e AS (SELECT 'k' || user_id AS pulse_key, ts FROM events WHERE event_id % 3 = 0), a AS (SELECT pulse_key, min(ts) AS t FROM e GROUP BY ALL), b AS (SELECT e.pulse_key, min(ts) AS t FROM e JOIN a ON e.pulse_key = a.pulse_key AND ts > t + INTERVAL 14 DAY GROUP BY ALL),
c AS (SELECT e.pulse_key, min(ts) AS t FROM e JOIN b ON e.pulse_key = b.pulse_key AND ts > t + INTERVAL 14 DAY GROUP BY ALL), s AS (FROM a UNION ALL FROM b UNION ALL FROM c)
SELECT pulse_key, count(*) AS n, (SELECT count(*) FROM s WHERE s.pulse_key = e.pulse_key) AS shown, strftime((SELECT max(t) FROM s WHERE s.pulse_key = e.pulse_key), '%Y-%m-%d %H:%M:%S') AS last_shown FROM e GROUP BY pulse_key""")
def q_pulse_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of users as a stream: each is shown once in fourteen days, and hidden in between."""
    src, out = place(spark, "pulse-source"), place(spark, "pulse")
    items = events(spark, sf_dir).filter("event_id % 3 = 0").select(F.concat(F.lit("k"), "user_id").alias("pulse_key"), "ts")
    items.write.parquet(src)
    pulse.use_state_store(spark)
    stream = pulse.pulse_branches(spark.readStream.schema("pulse_key string, ts timestamp").parquet(src))
    state.run_available(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows/batch={n}"), f"{out}/checkpoint")
    rows, show = spark.read.parquet(f"{out}/rows"), F.col("branch") == "SHOW"
    return rows.groupBy("pulse_key").agg(F.count("*").alias("n"), F.count_if(show).alias("shown"), F.date_format(F.max(F.when(show, F.col("ts"))), "yyyy-MM-dd HH:mm:ss").alias("last_shown"))
