"""The archive and what is saved between runs: cards to records, records to ledger rows, arms, roster changes and embeds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import scoring as S
from tidewatch.operators import bandit, evidence, roster
from tidewatch.plans.cards import _GRADE_SQL, _SCORE_SQL, scored
from tidewatch.plans.catalog import query, table
from tidewatch.plans.runs import UTC, place
from tidewatch.sources import archive, ledger
from tidewatch.sources.shared import kept

RUNS = (("r1", dt.datetime(2024, 1, 30, 8, tzinfo=UTC)), ("r2", dt.datetime(2024, 1, 31, 8, tzinfo=UTC)))
_ADMITTED = f"""SELECT *, CASE WHEN id % 2 = 0 THEN 'r1' ELSE 'r2' END AS run_id, CASE WHEN id % 2 = 0 THEN TIMESTAMP '2024-01-30 08:00:00' ELSE TIMESTAMP '2024-01-31 08:00:00' END AS last_seen, 'k' || id // 12 AS canonical_key,
  CASE WHEN id % 3 = 0 THEN 'c' || id % 9 ELSE '' END AS cluster_id, score >= 70 AS pushed, {_GRADE_SQL} AS grade, CASE WHEN id % 6 > 0 THEN side END AS item
  FROM ({_SCORE_SQL}) WHERE n_origins >= 2 AND score >= 55"""
_RECORDS = f"""SELECT *, coalesce(CASE WHEN id % 7 > 0 THEN TIMESTAMP '2024-01-01' + to_days((id % 20)::INTEGER) END, last_seen) AS first_seen,
  CASE WHEN id % 10 = 1 THEN 'given' || id ELSE 'op-' || left(sha1(canonical_key), 16) END AS opportunity_id FROM ({_ADMITTED})"""


def archive_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored orders as cards, of which many lack some fields; twelve order keys share a key."""
    n, score = F.col("id"), F.col("score")
    item = F.struct(F.col("side").alias("source"), F.concat(F.lit("https://o.example/"), n).alias("url"), F.lit("2024-01-30").alias("ts"))
    return scored(spark, sf_dir).select(
        "id", F.concat(F.lit("k"), F.floor(n / 12)).alias("canonical_key"), score.alias("final_score"), F.col("n_origins").alias("independent_source_count"), S.grade(score).alias("grade"),
        F.when(n % 10 == 1, F.concat(F.lit("given"), n)).when(n % 10 == 0, "").alias("opportunity_id"), F.when(n % 3 == 0, F.concat(F.lit("c"), n % 9)).alias("cluster_id"),
        F.when(n % 7 != 0, F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((n % 20).cast("int"))).alias("first_seen"),
        F.when(n % 4 == 0, "seen").alias("status"), F.when(n % 5 != 0, F.concat(F.lit("order "), n)).alias("title"), F.when(n % 2 == 0, F.array("side")).alias("focus_tags"),
        F.when(n % 6 != 0, F.array(item)).alias("evidence"), (score >= 70).alias("pushed"), F.when(n % 3 != 0, n % 3).alias("push_count"), F.col("stage").alias("lifecycle_stage"),
    )


def archived(spark: SparkSession, sf_dir: str) -> str:
    """The folder of an archive of two runs, of which the second was repeated."""
    cards, path = kept(archive_cards(spark, sf_dir), "archive-cards"), place(spark, "archive")
    for i, (run_id, now) in ((0, RUNS[0]), (1, RUNS[1]), (1, RUNS[1])):
        archive.append_archive(cards.filter(F.col("id") % 2 == i), path, now, run_id)
    return path


@query("SELECT id, CASE WHEN n_origins < 2 OR score < 55 THEN 'refused' ELSE 'would-archive' END AS outcome, CASE WHEN n_origins < 2 THEN 'sources' WHEN score < 55 THEN 'score' END AS reason FROM (" + _SCORE_SQL + ")")
def q_archive_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dry run of the archive says of each card."""
    return archive.append_archive(archive_cards(spark, sf_dir), place(spark, "archive"), RUNS[0][1], "dry", dry_run=True).select("id", "outcome", "reason")


@query(f"""
SELECT opportunity_id, canonical_key, cluster_id, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen, CASE WHEN id % 4 = 0 THEN 'seen' ELSE 'new' END AS status, CASE WHEN id % 5 <> 0 THEN 'order ' || id ELSE '' END AS title,
  score, grade, n_origins AS sources, pushed, id % 3 AS push_count, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS n_tags, CASE WHEN item IS NULL THEN 0 ELSE 1 END::BIGINT AS n_evidence, coalesce(stage, '') AS lifecycle_stage, run_id FROM ({_RECORDS})""")
def q_archive_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of an archive of two runs, the second one repeated: missing fields are filled and no card is there twice."""
    got = spark.read.parquet(archived(spark, sf_dir))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return got.select(
        "opportunity_id", "canonical_key", "cluster_id", text("first_seen"), text("last_seen"), "status", "title", "score", "grade", F.col("independent_source_count").cast("long").alias("sources"), "pushed", "push_count",
        F.size("focus_tags").cast("long").alias("n_tags"), F.size("evidence").cast("long").alias("n_evidence"), "lifecycle_stage", "run_id",
    )


@query(f"""
SELECT canonical_key, arg_max(opportunity_id, {{'t': last_seen, 's': score, 'l': coalesce(stage, ''), 'o': opportunity_id}}) AS opportunity_id, coalesce(arg_max(cluster_id, {{'t': last_seen, 'c': cluster_id}}) FILTER (WHERE cluster_id <> ''), '') AS cluster_id,
  strftime(min(first_seen), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(last_seen), '%Y-%m-%d %H:%M:%S') AS last_seen, arg_max(score, {{'t': last_seen, 's': score}}) AS last_score, count(*) FILTER (WHERE pushed) AS push_count,
  coalesce(array_to_string(list_sort(list(DISTINCT item) FILTER (WHERE item IS NOT NULL)), ','), '') AS source_set, least(count(*), 30) AS n_samples FROM ({_RECORDS}) GROUP BY canonical_key""")
def q_archive_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after the records of both runs: a key's first and last time, pushes, cluster and sources."""
    rows = archive.ledger_rows(spark.read.parquet(archived(spark, sf_dir)))
    book = ledger.Ledger(spark, place(spark, "archive-ledger"), buckets=16)
    for number, (_, now) in enumerate(RUNS):
        book.merge(rows.filter(F.col("last_seen") == F.lit(now)), number)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return book.rows().select("canonical_key", "opportunity_id", "cluster_id", text("first_seen"), text("last_seen"), "last_score", "push_count", F.array_join("source_set", ",").alias("source_set"), F.size("samples").cast("long").alias("n_samples"))


# ---------------------------------------------------------------- arms, roster, embeds

_ARMS = """CASE c_custkey % 6 WHEN 5 THEN '[{"alpha": 2}]' WHEN 4 THEN '{"a": {"alpha": 1' WHEN 3 THEN '{"a": {"alpha": "x", "beta": null, "n": "7"}, "b": {}}'
  ELSE '{"a": {"alpha": ' || CAST(floor(c_acctbal) AS BIGINT) || ', "beta": " 2.5 ", "n": ' || c_custkey || '.75}, "b": {"alpha": true, "beta": ' || (c_custkey % 9) || 'e-1, "n": -3}, "c": 7, "d": {"alpha": 3, "beta": "1e1", "n": "2.5"}}' END"""


@query("""
WITH c AS (SELECT c_custkey AS id, c_custkey % 6 AS k, greatest(floor(c_acctbal)::DOUBLE, 1e-9) AS a, greatest((c_custkey % 9) / 10.0::DOUBLE, 1e-9) AS b FROM customer), r AS (
  SELECT id, 'a' AS track, a AS alpha, 2.5::DOUBLE AS beta, id AS n FROM c WHERE k < 3 UNION ALL SELECT id, 'b', 1.0, b, 0 FROM c WHERE k < 3 UNION ALL SELECT id, 'd', 3.0, 10.0, 0 FROM c WHERE k < 3
  UNION ALL SELECT id, 'a', 1.0, 1.0, 7 FROM c WHERE k = 3 UNION ALL SELECT id, 'b', 1.0, 1.0, 0 FROM c WHERE k = 3)
SELECT id, track, round(alpha, 9) AS alpha, round(beta, 9) AS beta, n::BIGINT AS n, round(alpha / (alpha + beta), 6) AS mean, round(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1)), 6) AS variance FROM r""")
def q_saved_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms from saved states of any shape, a state a customer, with their means and variances."""
    states = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(_ARMS).alias("body"))
    arms = bandit.read_arms(states, "id", "body")
    a, b = F.col("alpha"), F.col("beta")
    return arms.select("id", "track", F.round(a, 9).alias("alpha"), F.round(b, 9).alias("beta"), "n", F.round(bandit.posterior_mean(a, b), 6).alias("mean"), F.round(bandit.posterior_variance(a, b), 6).alias("variance"))


@query("""
SELECT CASE WHEN c_custkey % 5 = 0 THEN 'USER' ELSE '@User' END || c_custkey AS handle, CASE WHEN c_custkey % 5 = 0 THEN 'moved' ELSE 't' || c_nationkey END AS track, (CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 + c_custkey % 2 END)::INTEGER AS tier,
  c_custkey % 3 > 0 AS enabled FROM customer UNION ALL SELECT 'n' || c_custkey, 'new', 1, c_custkey % 3 > 0 FROM customer WHERE c_custkey % 7 = 0""")
def q_roster_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A roster after a fifth of its handles were replaced and others added, and a third of all were switched off."""
    c, n = table(spark, sf_dir, "customer"), F.col("c_custkey")

    def entries(rows: DataFrame, head: str, track, tier, provenance: str) -> DataFrame:
        none = F.lit(None).cast("string")
        return rows.select(
            n.alias("pos"), F.concat(F.lit(head), n).alias("handle"), track.alias("track"), tier.cast("int").alias("tier"), F.lit(True).alias("enabled"), F.lit("2024-01-02T00:00:00Z").alias("added_at"), F.lit(provenance).alias("provenance"), none.alias("topic_filter"), none.alias("notes"),
        )

    old = entries(c, "@User", F.concat(F.lit("t"), "c_nationkey"), 1 + n % 2, "seed")
    new = entries(c.filter(n % 5 == 0), "USER", F.lit("moved"), F.lit(2), "approved").unionByName(entries(c.filter(n % 7 == 0), "n", F.lit("new"), F.lit(1), "approved"))
    off = c.filter(n % 3 == 0).select(F.explode(F.array(F.concat(F.lit("user"), n), F.concat(F.lit("@N"), n))).alias("handle"), F.lit(False).alias("enabled"))
    return roster.set_enabled(roster.upsert(old, new), off).select("handle", "track", "tier", "enabled")


@query("""
WITH p AS (SELECT doc_id, coalesce(source, '') AS title, coalesce(text, '') AS description, string_split(coalesce(text, ''), '. ') AS parts FROM documents),
e AS (SELECT doc_id, len(parts) AS n_fields, len(list_filter(parts, lambda x: length(x) > 1024)) AS n_long, length(title) + length(description) + coalesce(list_sum(list_transform(parts, lambda x: 1 + length(x))), 0) AS total FROM p)
SELECT doc_id, (n_long + CASE WHEN n_fields > 25 THEN 1 ELSE 0 END + CASE WHEN total > 6000 THEN 1 ELSE 0 END)::BIGINT AS n_errors, n_fields > 25 AS many, total > 6000 AS long FROM e""")
def q_embed_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limits that an embed of each document would break, were each of its sentences a field."""
    d = table(spark, sf_dir, "documents")
    parts = F.split(F.coalesce("text", F.lit("")), r"\. ", -1)
    fields = F.transform(parts, lambda x: F.struct(F.lit("f").alias("name"), x.alias("value")))
    errors = evidence.embed_errors(F.col("source"), F.col("text"), F.lit(None).cast("string"), fields)
    got = d.select("doc_id", errors.alias("e"))
    return got.select("doc_id", F.size("e").cast("long").alias("n_errors"), F.array_contains("e", "too many fields").alias("many"), F.array_contains("e", "too long").alias("long"))
