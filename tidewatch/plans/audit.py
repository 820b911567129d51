"""Personal data, the roster, evidence and settings: queries over analogues in the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import fixed as K
from tidewatch.functions import scoring as S
from tidewatch.operators import bandit, classify, evidence, gate, privacy, roster
from tidewatch.plans.catalog import query, table

_DOMAINS = ", ".join(f"'{d}'" for d in privacy.PERSONAL_DOMAINS)
_BLANK = ", ".join(f"'{d}'" for d in privacy.PLACEHOLDERS)
_KEPT = ", ".join(f"'{d}'" for d in privacy.ALLOWED_DOMAINS)
_SUFFIX = "|".join(s.replace(".", "[.]") for s in privacy.ALLOWED_SUFFIXES)


@query(rf"""
WITH t AS (SELECT doc_id, replace(regexp_replace(text, 'mail[0-4][.]example', 'gmail', 'g'), ') 555', ') 455') AS text FROM documents), e AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9][A-Za-z0-9.\-]*\.[A-Za-z]{{2,}}\b')) AS value FROM t),
d AS (SELECT *, lower(split_part(value, '@', 1)) AS l, lower(split_part(value, '@', -1)) AS d FROM e),
m AS (SELECT doc_id, CASE WHEN d IN ({_DOMAINS}) AND l NOT IN ({_BLANK}) THEN 'PERSONAL-MAILBOX' WHEN NOT (d IN ({_KEPT}) OR regexp_matches(d, '^example[-.]|({_SUFFIX})$')) THEN 'EMAIL' END AS label, value FROM d),
p AS (SELECT DISTINCT doc_id, 'PHONE' AS label, regexp_replace(unnest(regexp_extract_all(text, '\([2-9]\d{{2}}\) [2-9]\d{{2}}-\d{{4}}')), '.(\d+). (.*)', '\1-\2') AS value FROM t)
SELECT * FROM m WHERE label IS NOT NULL UNION ALL SELECT * FROM p WHERE NOT regexp_matches(value, '^(555-|...-555-)')
""")
def q_structural_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mailboxes, other addresses, phone numbers, postal codes and home paths in the documents.

    The table's addresses and numbers are examples, so some are changed first; it has no postal codes and no paths.
    """
    docs = table(spark, sf_dir, "documents").withColumn("text", F.replace(F.regexp_replace("text", "mail[0-4][.]example", "gmail"), F.lit(") 555"), F.lit(") 455")))
    return privacy.scan(docs, "doc_id", "text", private_dirs=["secrets"])


_ENTRIES = """SELECT c_custkey AS pos, CASE WHEN c_custkey % 13 = 0 THEN '  ' WHEN c_custkey % 11 = 0 THEN '@Dup_' || CAST(c_custkey % 3 AS VARCHAR) WHEN c_custkey % 17 = 0 THEN 'much-too-long-handle' ELSE 'User' || CAST(c_custkey AS VARCHAR) END AS handle,
  CASE WHEN c_custkey % 19 <> 0 THEN lower(c_mktsegment) END AS track, CAST(1 + c_nationkey % 3 AS INT) AS tier, c_custkey % 4 <> 0 AS enabled, CASE WHEN c_custkey % 23 = 0 THEN 'long ago' ELSE '2024-01-02T03:04:05Z' END AS added_at,
  CASE c_custkey % 5 WHEN 0 THEN 'found' WHEN 1 THEN 'approved' ELSE 'seed' END AS provenance, CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'gpu' END AS topic_filter, CAST(NULL AS VARCHAR) AS notes FROM customer"""


def _roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("__roster_source")
    return spark.sql(_ENTRIES.replace("FROM customer", "FROM __roster_source").replace("VARCHAR", "STRING"))


@query(f"""
WITH r AS ({_ENTRIES}), k AS (SELECT *, CASE WHEN trim(handle) <> '' THEN lower(regexp_replace(trim(handle), '^@', '')) END AS k FROM r), f AS (SELECT k, min(pos) AS first FROM k WHERE k IS NOT NULL GROUP BY k)
SELECT pos, array_to_string(list_filter([CASE WHEN track IS NULL THEN 'missing track' END, CASE WHEN trim(handle) = '' THEN 'handle empty' END, CASE WHEN trim(handle) <> '' AND NOT regexp_full_match(regexp_replace(trim(handle), '^@', ''), '[A-Za-z0-9_]{{1,15}}') THEN 'handle malformed' END,
  CASE WHEN tier NOT IN (1, 2) THEN 'tier not 1 or 2' END, CASE WHEN provenance NOT IN ('seed', 'approved') THEN 'provenance unknown' END, CASE WHEN added_at = 'long ago' THEN 'added_at no time' END, CASE WHEN topic_filter = '' THEN 'topic_filter empty' END,
  CASE WHEN pos > first THEN 'duplicate handle' END], lambda e: e IS NOT NULL), '; ') AS errors FROM k LEFT JOIN f USING (k)
""")
def q_roster_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each roster entry, repeated handles included."""
    return roster.validated(_roster(spark, sf_dir)).select("pos", F.array_join("errors", "; ").alias("errors"))


@query(f"SELECT pos, regexp_replace(trim(handle), '^@', '') AS handle, track, tier, nullif(topic_filter, '') AS topic_filter, 500 AS min_faves FROM ({_ENTRIES}) WHERE tier = 1 AND enabled AND trim(handle) <> '' AND pos % 10 <> 1")
def q_pull_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pulls of a run after every tenth handle was switched off; the floor of likes is clamped to its cap."""
    r = _roster(spark, sf_dir)
    off = r.filter("pos % 10 = 1 AND trim(handle) <> '' AND pos % 11 <> 0 AND pos % 17 <> 0").select("handle", F.lit(False).alias("enabled"))
    kept = r.filter("NOT (pos % 10 = 1 AND (trim(handle) = '' OR pos % 11 = 0 OR pos % 17 = 0))")
    return roster.pull_plan(roster.set_enabled(kept, off), min_faves=1e6)


@query("""
SELECT l_orderkey AS id, array_to_string(list_sort(list(DISTINCT o)), ',') AS origins FROM (
  SELECT l_orderkey, unnest([CASE WHEN l_linenumber % 3 <> 0 THEN 'handle:supp' || l_suppkey END, CASE WHEN l_linenumber % 2 = 0 THEN 'source:' || lower(l_returnflag) END]) AS o FROM lineitem) WHERE o IS NOT NULL GROUP BY ALL
""")
def q_evidence_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accounts and sources that each card's evidence credits; an item may credit both."""
    n = F.col("l_linenumber")
    item = F.struct(F.when(n % 3 != 0, F.concat(F.lit(" @Supp"), "l_suppkey")).alias("origin_handle"), F.when(n % 2 == 0, F.col("l_returnflag")).alias("origin_source"))
    cards = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(item).alias("evidence"))
    named = F.transform(evidence.evidence_origins(F.col("evidence")), lambda o: F.concat_ws(":", o["kind"], o["name"]))
    return cards.select("id", F.array_join(F.array_sort(named), ",").alias("origins")).filter("origins <> ''")


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'op:o' || user_id WHEN event_id % 3 = 1 THEN 'ck:k' || user_id ELSE 'id:' || event_id END AS opportunity, CASE WHEN event_id % 4 < 2 THEN 'handle:u' || user_id WHEN event_id % 4 = 2 THEN 'source:' || event_type END AS origin,
  CASE WHEN event_id % 2 = 0 THEN 'last' WHEN event_id % 5 <> 0 THEN 'first' END AS seen FROM events
""")
def q_record_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each record is counted under, the origin of its pull line and its time, by their fallbacks."""
    n, user = F.col("event_id"), F.col("user_id").cast("string")
    key = evidence.opportunity_key(F.when(n % 3 == 0, F.concat(F.lit("o"), user)).otherwise(" "), F.when(n % 3 == 1, F.concat(F.lit("k"), user)), n)
    origin = evidence.pull_origin(F.when(n % 4 < 2, F.concat(F.lit("@U"), user)), F.when(n % 4 != 3, F.col("event_type")))
    seen = evidence.record_time(F.when(n % 2 == 0, F.lit("last")).otherwise(""), F.when(n % 5 != 0, F.lit("first")))
    return table(spark, sf_dir, "events").select("event_id", key.alias("opportunity"), F.concat_ws(":", origin["kind"], origin["name"]).alias("origin"), seen.alias("seen")).withColumn("origin", F.nullif("origin", F.lit("")))


_WEIGHTS = {"machinery": 1.2, "building": 0.8}


@query("SELECT c_custkey AS id, round(CAST(CASE lower(c_mktsegment) WHEN 'machinery' THEN 1.2 WHEN 'building' THEN 0.8 ELSE 1.0 END AS DOUBLE) * CAST(CASE WHEN c_custkey % 2 = 0 THEN 1.25 ELSE 1 END AS DOUBLE), 6) AS weight FROM customer")
def q_track_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configured weight of each track, nudged where the bandit has drawn."""
    weight = S.effective_track_weight(F.lower("c_mktsegment"), _WEIGHTS, F.when(F.col("c_custkey") % 2 == 0, F.lit(1.25)))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), weight.alias("weight"))


@query(r"""
SELECT doc_id, CASE WHEN length(t) <= 200 THEN t WHEN length(k) >= 100 THEN trim(k, chr(9) || chr(10) || chr(13) || ' ') ELSE rtrim(left(t, 200), chr(9) || chr(10) || chr(13) || ' ') || '…' END AS summary, replace(replace(trim(regexp_replace(t, '\s+', ' ', 'g')), chr(96), ''''), '|', '/') AS cell
FROM (SELECT doc_id, t, regexp_extract(left(t, 200), '(?s)^(.*(?:[。！？；]|[.!?] ))', 1) AS k FROM (SELECT doc_id, trim(coalesce(text, ''), chr(9) || chr(10) || chr(13) || ' ') AS t FROM documents))
""")
def q_show_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text cut after a sentence, and as a table cell."""
    return table(spark, sf_dir, "documents").select("doc_id", evidence.truncated(F.col("text"), 200).alias("summary"), evidence.cell(F.col("text")).alias("cell"))


@query("SELECT min(name) AS track, CAST(2.0 AS DOUBLE) AS theta FROM (SELECT lower(c_mktsegment) AS name FROM customer)")
def q_best_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arm with the greatest draw; all tie here, so the first name."""
    return bandit.best_track(table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("track"), F.lit(2.0).alias("theta")).distinct())


_TOPICS = ", ".join(f"CASE WHEN {' OR '.join(f"contains(x, '{w}')" for w in t.lower().split() if len(w) > 3)} THEN '{t}' END" for t in K.FOCUS_TOPICS)


@query(f"SELECT doc_id, array_to_string(list_sort(list_filter([{_TOPICS}], lambda t: t IS NOT NULL)), ',') AS tags FROM (SELECT doc_id, lower(coalesce(text, '')) AS x FROM documents)")
def q_focus_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The focus topics that each document has a word of."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(classify.focus_tags(F.lower(F.coalesce("text", F.lit("")))), ",").alias("tags"))


_PLACES = r"""text || CASE doc_id % 6 WHEN 0 THEN ' Ship to: Main St 94' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') WHEN 1 THEN ' postal code 12345' WHEN 2 THEN ' /home/dev' || CAST(doc_id AS VARCHAR) || '/x' WHEN 3 THEN ' C:\Users\Alice\x C:\Users\pat7'
  WHEN 4 THEN ' ~/.secrets/key' || CAST(doc_id AS VARCHAR) ELSE ' zip file 54321' END"""
_USERS = ", ".join(f"'{u}'" for u in privacy.GENERIC_USERS)


@query(rf"""
WITH t AS (SELECT doc_id, {_PLACES} AS text FROM documents)
SELECT DISTINCT * FROM (SELECT doc_id, 'ZIP' AS label, unnest(regexp_extract_all(text, '(?i)(?:\bzip\s*code\b|\bpostal\s*code\b|邮编|\bship(?:ping)?\s+to\b|\bdeliver\s+to\b)[^\n]{{0,24}}?\b([0-9]{{5}})\b', 1)) AS value FROM t) WHERE value NOT IN ('10001', '00000', '12345', '90210')
UNION ALL SELECT DISTINCT * FROM (SELECT doc_id, 'USER-PATH' AS label, unnest(regexp_extract_all(text, '(?:[A-Za-z]:\\{{1,4}}Users\\{{1,4}}|/(?:home|Users)/)[A-Za-z0-9][\w.\-]{{0,31}}')) AS value FROM t) WHERE lower(regexp_extract(value, '([^\\/]*)$', 1)) NOT IN ({_USERS})
UNION ALL SELECT DISTINCT doc_id, 'PRIVATE-PATH', unnest(regexp_extract_all(text, '(?i)(?:~|\$HOME|\$env:USERPROFILE|\$env:HOME|%USERPROFILE%)[\\/]\.secrets\b[\w./\\-]*')) FROM t
""")
def q_scan_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postal codes and home paths: each document is given one, some of which are allowed or none."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.expr(_PLACES.replace("\\", "\\\\").replace("VARCHAR", "STRING")))
    return privacy.scan(docs, "doc_id", "text", private_dirs=["secrets"]).filter("label IN ('ZIP', 'USER-PATH', 'PRIVATE-PATH')")


@query("""
WITH a AS (SELECT c_nationkey::VARCHAR AS track, 1.0::DOUBLE + count(*) FILTER (WHERE c_acctbal > 5000) AS a, 1.0::DOUBLE + count(*) FILTER (WHERE c_acctbal <= 5000) AS b FROM customer GROUP BY ALL)
SELECT track, round(a / (a + b), 6) AS theta, round(a * b / ((a + b) * (a + b) * (a + b + 1)), 9) AS variance FROM a ORDER BY theta DESC, track LIMIT 1
""")
def q_best_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation whose customers reward most, by the means of posteriors that differ, with its variance."""
    won = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("track"), (F.col("c_acctbal") > 5000).cast("double").alias("reward"))
    arms = bandit.fold_rewards(spark.createDataFrame([], "track string, alpha double, beta double, n long"), won)
    a, b = F.col("alpha"), F.col("beta")
    return bandit.best_track(arms.select("track", F.round(bandit.posterior_mean(a, b), 6).alias("theta"), F.round(bandit.posterior_variance(a, b), 9).alias("variance")))


_FLAWS = ", ".join(f"CASE WHEN id % {12 + i} = 0 OR (id * {i}) % 130 - 10 NOT BETWEEN 0 AND 100 THEN 'breakdown.{n}' END" for i, n in enumerate(K.DIMENSIONS, 1))


@query(f"""
SELECT id, array_to_string(list_filter([CASE WHEN id % 11 = 0 THEN 'track' END, {_FLAWS}, CASE WHEN id % 17 = 0 OR id % 120 - 5 NOT BETWEEN 0 AND 100 THEN 'final_score' END, CASE WHEN good < 2 THEN 'evidence' END, CASE WHEN n < 2 THEN 'sources' END,
  CASE WHEN id % 13 = 0 THEN 'why_now' END, CASE WHEN id % 9 = 0 THEN 'action' END], lambda e: e IS NOT NULL), ',') AS errors, good
FROM (SELECT l_orderkey AS id, count(*) FILTER (WHERE l_linenumber % 4 <> 0 AND l_suppkey % 5 <> 0 AND l_partkey % 7 <> 0) AS good, count(DISTINCT l_suppkey % 3) AS n FROM lineitem GROUP BY ALL)
""")
def q_gate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of the gate: dimensions and scores that are missing or out of range, evidence without address, source or time."""
    item = F.struct(
        F.when(F.col("l_linenumber") % 4 == 0, "").otherwise("http://u").alias("url"), F.when(F.col("l_suppkey") % 5 != 0, "s").alias("source"), F.when(F.col("l_partkey") % 7 != 0, F.col("l_shipdate")).alias("ts"),
    )
    cards = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(item).alias("evidence"), F.countDistinct(F.col("l_suppkey") % 3).alias("n"))
    k, good = F.col("id"), evidence.well_formed(F.col("evidence"))
    dims = {name: F.when(k % (12 + i) != 0, (k * i) % 130 - 10) for i, name in enumerate(K.DIMENSIONS, 1)}
    errors = gate.card_errors(F.when(k % 11 == 0, "").otherwise("t"), dims, F.when(k % 17 != 0, k % 120 - 5), good, F.col("n"), F.when(k % 13 == 0, " ").otherwise("now"), F.when(k % 9 != 0, "act"))
    return cards.select("id", F.array_join(errors, ",").alias("errors"), good.cast("long").alias("good"))
