"""Rankings: drift under new weights, and the rumour lane."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import fixed as K
from tidewatch.functions import scoring as S
from tidewatch.functions import text as T
from tidewatch.operators import drift, pulse
from tidewatch.plans.cards import _SCORE_SQL, scored
from tidewatch.plans.catalog import query, table

_SCORES = "SELECT p_partkey AS id, CAST((p_partkey * 37) % 101 AS DOUBLE) AS a, CAST(((p_partkey * 37) % 101 + (p_partkey * 53) % 40) AS DOUBLE) AS b FROM part"


def _drift_sql(scores: str) -> str:
    return f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY a DESC, id::VARCHAR) AS ra, row_number() OVER (ORDER BY b DESC, id::VARCHAR) AS rb FROM ({scores})), c AS (SELECT count(*) AS n FROM r),
t AS (SELECT count(*) AS bad FROM r x JOIN r y ON x.ra < y.ra AND x.rb > y.rb), m AS (SELECT max(abs(ra - rb)) AS max_shift, round(count(*) FILTER (WHERE (a >= 70) <> (b >= 70)) / greatest(count(*) FILTER (WHERE a >= 70 OR b >= 70), 1), 6) AS push_churn,
round(count(*) FILTER (WHERE ra <= n // 2 AND rb > n // 2) / (max(n) // 2), 6) AS top_churn FROM r, c)
SELECT n, tau, max_shift, push_churn, top_churn, CASE WHEN tau >= 0.6 OR push_churn >= 0.5 THEN 'block' WHEN tau > 0.25 OR push_churn > 0.2 THEN 'needs_review' ELSE 'auto_pass' END AS verdict FROM (SELECT n, round(bad / (n * (n - 1) / 2), 6) AS tau, max_shift, push_churn, top_churn FROM c, t, m)
"""


@query(_drift_sql(_SCORES))
def q_kendall_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a second score reorders the parts, and the verdict on it."""
    p = F.col("p_partkey")
    s = table(spark, sf_dir, "part").select(p.alias("id"), ((p * 37) % 101).cast("double").alias("a"), ((p * 37) % 101 + (p * 53) % 40).cast("double").alias("b"))
    out = drift.rank_drift(s)
    return out.select(F.col("n"), "tau", F.col("max_shift").cast("long").alias("max_shift"), "push_churn", "top_churn", "verdict")


# The rubric of the supply side under the shipped weights (a) and others (b).
OTHER_WEIGHTS = (0.3, 0.1, 0.2, 0.2, 0.2)
_WEIGHED = "CAST(round(CAST(least(greatest(({raw}) * conf * fresh2 * (1 + (least(greatest(tw, 0.5), 1.5) - 1) * 0.5) * sw, 0.0), 100.0) AS DECIMAL(30, 15)), 4) AS DOUBLE)"
_TWO_SCORES = (
    "SELECT id, " + _WEIGHED.format(raw="0.0 + d1 * 0.2::DOUBLE + d2 * 0.25::DOUBLE + d3 * 0.2::DOUBLE + d4 * 0.15::DOUBLE + d5 * 0.2::DOUBLE") + " AS a, "
    + _WEIGHED.format(raw="0.0 + d1 * 0.3::DOUBLE + d2 * 0.1::DOUBLE + d3 * 0.2::DOUBLE + d4 * 0.2::DOUBLE + d5 * 0.2::DOUBLE") + f" AS b FROM ({_SCORE_SQL})"
)


def two_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scored(spark, sf_dir)
    dims, rest = [F.col(f"d{i}") for i in range(1, 6)], [F.col(x) for x in ("n_origins", "age", "velocity", "tw", "stage")]
    return c.select("id", *[S.final_score_with(w, dims, *rest).alias(x) for x, w in (("a", K.SUPPLY_WEIGHTS), ("b", OTHER_WEIGHTS))])


@query(_TWO_SCORES)
def q_weight_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each card's score under the shipped weights and under others."""
    return two_scores(spark, sf_dir)


@query(_drift_sql(_TWO_SCORES))
def q_weight_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far other weights would reorder the cards, and whether they may be taken."""
    out = drift.rank_drift(two_scores(spark, sf_dir))
    return out.select("n", "tau", F.col("max_shift").cast("long").alias("max_shift"), "push_churn", "top_churn", "verdict")


@query("""
SELECT event_id, round(CASE WHEN event_id % 11 = 0 THEN 0.5 ELSE round(least(greatest(0.8 * pow(0.5::DOUBLE, age / 72.0::DOUBLE) + 0.2 * pow(24 / (age + 24), 1.8::DOUBLE / 6), 0.0), 1.0), 6) END + heat / (heat + 25.0::DOUBLE), 6) AS rank
FROM (SELECT event_id, greatest((epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts)) / 3600000000.0::DOUBLE, 0.0) AS age, CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 THEN 0.0 ELSE floor(value) END AS heat FROM events)""")
def q_pulse_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rumour lane's rank of each event as of January the 20th: some have no time, some no heat, some a negative one; later ones are of age 0."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    heat = F.when(n % 7 == 0, None).when(n % 5 == 0, -F.floor("value")).otherwise(F.floor("value"))
    fresh = F.when(n % 11 != 0, S.freshness(S.age_hours(F.col("ts").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))))
    return e.select("event_id", F.round(S.pulse_rank(fresh, heat), 6).alias("rank"))


_PKEY = r"CASE WHEN u <> '' THEN 'u:' || u ELSE '' END AS pulse_key FROM (SELECT page_id, url, regexp_replace(split_part(split_part(lower(trim(url)), '#', 1), '?', 1), '/+$', '') AS u FROM pages)"


@query("SELECT page_id, " + _PKEY)
def q_pulse_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key under which a page is remembered."""
    return table(spark, sf_dir, "pages").select("page_id", T.pulse_key(F.col("url"), F.lit(None).cast("string")).alias("pulse_key"))


@query(f"""
WITH i AS (SELECT page_id, page_id % 97 AS heat, {_PKEY}), f AS (SELECT pulse_key, min(page_id) AS page_id FROM i WHERE pulse_key <> '' AND page_id % 5 <> 0 AND pulse_key NOT IN (SELECT pulse_key FROM i WHERE page_id % 5 = 0) GROUP BY ALL)
SELECT page_id, pulse_key, round(0.5 + heat / (heat + 25.0), 6) AS rank FROM (SELECT f.page_id, f.pulse_key, f.page_id % 97 AS heat FROM f) ORDER BY rank DESC, page_id DESC LIMIT 8
""")
def q_pulse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best unseen pages (every fifth was seen before), one for each key."""
    p = table(spark, sf_dir, "pages").select("page_id", T.pulse_key(F.col("url"), F.lit(None).cast("string")).alias("pulse_key"))
    rank = S.pulse_rank(F.lit(None).cast("double"), F.col("page_id") % 97)
    items = p.filter("page_id % 5 <> 0").select("pulse_key", F.col("page_id").alias("pos"), F.round(rank, 6).alias("rank"), F.timestamp_seconds("page_id").alias("ts"), F.lit("").alias("title"), "page_id")
    return pulse.select_rendered(items, p.filter("page_id % 5 = 0")).select("page_id", "pulse_key", "rank")


@query("""
SELECT conv_id, count(*) AS turns, max(turn) AS last_turn, count(*) FILTER (WHERE role = prev) AS repeats, sum(length(text))::BIGINT AS chars
FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev FROM conversations) GROUP BY ALL
""")
def q_role_turn_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation and how often a role speaks twice in a row (an extension)."""
    from pyspark.sql.window import Window

    c = table(spark, sf_dir, "conversations")
    prev = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return c.withColumn("prev", prev).groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn"), F.count_if(F.col("role") == F.col("prev")).alias("repeats"), F.sum(F.length("text")).alias("chars"))
