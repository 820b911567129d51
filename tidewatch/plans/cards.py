"""Cards from orders: origins, scores, grades, gates and classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import fixed as K
from tidewatch.functions import scoring as S
from tidewatch.operators import classify, gate, origins, pulse
from tidewatch.plans.catalog import query, table

NOW = "2024-01-31 00:00:00"

# One row for each order: figures of its evidence and inputs of the rubric, all from columns.
_CARD_SQL = """
  SELECT o.o_orderkey AS id, count(l.l_orderkey) AS n_evidence, count(DISTINCT l.l_suppkey) AS n_origins,
    coalesce(sum(CAST(l.l_quantity AS BIGINT)), 0) AS qty, o.o_totalprice AS price, o.o_orderpriority AS prio, o.o_orderstatus AS status, o.o_custkey AS cust
  FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY ALL"""
_DIMS_SQL = """
  SELECT id, n_evidence, n_origins, CAST((qty * 7) % 101 AS DOUBLE) AS d1, CAST((qty * 11 + 40) % 101 AS DOUBLE) AS d2, CAST((qty * 13 + 55) % 101 AS DOUBLE) AS d3,
    CAST((qty * 17 + 60) % 101 AS DOUBLE) AS d4, CAST((qty * 19 + 35) % 101 AS DOUBLE) AS d5,
    CAST(id % 100 AS DOUBLE) AS age, CASE WHEN id % 3 = 0 THEN (id % 7) / 10.0 - 0.2 END AS velocity, 0.513717 + (cust % 11) / 10.0 AS tw,
    CASE id % 5 WHEN 0 THEN 'emerging' WHEN 1 THEN 'peak' WHEN 2 THEN 'declining' WHEN 3 THEN 'fading' END AS stage,
    CASE WHEN status = 'O' THEN 'demand' ELSE 'supply' END AS side, CAST(id % 101 AS DOUBLE) AS crowd
  FROM (""" + _CARD_SQL + ")"
_SCORE_SQL = """
  SELECT *, CAST(round(CAST(least(greatest(raw * conf * fresh3 * (1 + (least(greatest(tw, 0.5), 1.5) - 1) * 0.5) * sw * cw, 0.0), 100.0) AS DECIMAL(30, 15)), 4) AS DOUBLE) AS score FROM (
  SELECT *, CASE WHEN side = 'demand' THEN greatest(fresh2, 0.6) ELSE fresh2 END AS fresh3 FROM (
  SELECT *, CASE WHEN velocity IS NOT NULL THEN round(least(greatest(fresh1 * (1 + 0.15 * velocity), 0.0), 1.0), 6) ELSE fresh1 END AS fresh2 FROM (
  SELECT *, round(least(greatest(0.8 * pow(0.5::DOUBLE, age / 72.0::DOUBLE) + 0.2 * pow(24 / (age + 24), 1.8::DOUBLE / 6), 0.0), 1.0), 6) AS fresh1,
    CASE WHEN side = 'demand' THEN 0.0 + d1 * 0.1::DOUBLE + d2 * 0.1::DOUBLE + d3 * 0.25::DOUBLE + d4 * 0.3::DOUBLE + d5 * 0.25::DOUBLE
         ELSE 0.0 + d1 * 0.2::DOUBLE + d2 * 0.25::DOUBLE + d3 * 0.2::DOUBLE + d4 * 0.15::DOUBLE + d5 * 0.2::DOUBLE END AS raw,
    CASE WHEN n_origins >= 3 THEN 1.0::DOUBLE WHEN n_origins = 2 THEN 0.8 ELSE 0.5 END AS conf,
    CASE stage WHEN 'peak' THEN 0.9::DOUBLE WHEN 'declining' THEN 0.75 WHEN 'fading' THEN 0.55 ELSE 1.0 END AS sw,
    CASE WHEN side = 'demand' THEN round(greatest(0.1::DOUBLE, 1 - 0.7::DOUBLE * crowd / 100), 6) ELSE 1.0::DOUBLE END AS cw
  FROM (""" + _DIMS_SQL + "))))"
_GRADE_SQL = "CASE WHEN score >= 85 THEN 'A' WHEN score >= 75 THEN 'B+' WHEN score >= 65 THEN 'B' WHEN score >= 55 THEN 'C+' WHEN score >= 45 THEN 'C' ELSE 'D' END"


def card_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with figures of their line items; those without any stay, at zero."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n_evidence"), F.count_distinct("l_suppkey").alias("n_origins"), F.sum(F.col("l_quantity").cast("long")).alias("qty")
    )
    orders = table(spark, sf_dir, "orders")
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left").select(
        F.col("o_orderkey").alias("id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_evidence", "n_origins", "qty")],
        F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, n_evidence, n_origins, side, dims, score): the rubric over every order."""
    c = card_inputs(spark, sf_dir)
    dims = [((F.col("qty") * a + b) % 101).cast("double").alias(f"d{i}") for i, (a, b) in enumerate(((7, 0), (11, 40), (13, 55), (17, 60), (19, 35)), 1)]
    c = c.select(
        "id", "n_evidence", "n_origins", *dims, (F.col("id") % 100).cast("double").alias("age"),
        F.when(F.col("id") % 3 == 0, (F.col("id") % 7) / 10.0 - 0.2).alias("velocity"),
        (0.513717 + (F.col("cust") % 11) / 10.0).alias("tw"),
        F.get(F.array(*[F.lit(s) for s in ("emerging", "peak", "declining", "fading")]), (F.col("id") % 5).cast("int")).alias("stage"),
        F.when(F.col("status") == "O", "demand").otherwise("supply").alias("side"), (F.col("id") % 101).cast("double").alias("crowd"),
    )
    score = S.final_score([F.col(f"d{i}") for i in range(1, 6)], F.col("n_origins"), F.col("age"), F.col("velocity"), F.col("tw"), F.col("stage"), F.col("side"), F.col("crowd"))
    return c.withColumn("score", score)


@query("SELECT id, n_evidence, n_origins, CASE WHEN n_origins >= 2 THEN 'card' ELSE 'below_sources' END AS lane FROM (" + _CARD_SQL + ")")
def q_origin_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct origins of each order's evidence, and its lane."""
    c = card_inputs(spark, sf_dir)
    return c.select("id", "n_evidence", "n_origins", origins.lane(F.col("n_origins"), F.lit(False)).alias("lane"))


@query("""
WITH e AS (SELECT l_orderkey, 'x.com/s' || (l_suppkey % 5) AS origin, CASE WHEN l_linenumber % 2 = 0 THEN 's' || (l_partkey % 5) END AS via,
    CASE WHEN l_orderkey % 2 = 0 THEN 'http://u/' || (l_partkey % 3) ELSE CASE WHEN l_linenumber > 1 THEN 'http://u/' || l_partkey ELSE '' END END AS url FROM lineitem),
o AS (SELECT e.l_orderkey, e.origin, bool_and(coalesce(e.via IS NOT NULL AND 'x.com/' || e.via <> e.origin AND p.origin IS NOT NULL, false)) AS derived
    FROM e LEFT JOIN (SELECT DISTINCT l_orderkey, origin FROM e) p ON p.l_orderkey = e.l_orderkey AND p.origin = 'x.com/' || e.via GROUP BY ALL),
k AS (SELECT l_orderkey, count(*) FILTER (WHERE NOT derived) AS n FROM o GROUP BY ALL),
u AS (SELECT l_orderkey, bool_and(url <> '') AS every, count(DISTINCT url) AS n_urls FROM e GROUP BY ALL)
SELECT k.l_orderkey AS id, CAST(CASE WHEN every THEN least(n, n_urls) ELSE n END AS INTEGER) AS n_independent FROM k JOIN u USING (l_orderkey)
""")
def q_independent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent origins of each order: quote-derived ones discounted, republished addresses counted once."""
    li = table(spark, sf_dir, "lineitem")
    item = F.struct(
        F.concat(F.lit("x.com/s"), F.col("l_suppkey") % 5).alias("origin"), F.lit("").alias("source"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("s"), F.col("l_partkey") % 5)).alias("via_handle"),
        F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("http://u/"), F.col("l_partkey") % 3)).when(F.col("l_linenumber") > 1, F.concat(F.lit("http://u/"), F.col("l_partkey"))).otherwise("").alias("url"),
    )
    cards = li.groupBy("l_orderkey").agg(F.collect_list(item).alias("evidence"))
    return cards.select(F.col("l_orderkey").alias("id"), origins.independent_sources(F.col("evidence")).alias("n_independent"))


@query("SELECT id, n_origins, side, raw, conf, fresh3 AS freshness, score, " + _GRADE_SQL + " AS grade FROM (SELECT * REPLACE (round(raw, 6) AS raw) FROM (" + _SCORE_SQL + "))")
def q_confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rubric's score and grade of every order, with its main factors."""
    c = scored(spark, sf_dir)
    dims = [F.col(f"d{i}") for i in range(1, 6)]
    return c.select(
        "id", "n_origins", "side", F.round(S.side_raw(dims, F.col("side")), 6).alias("raw"), S.confidence(F.col("n_origins")).alias("conf"),
        S.adjusted_freshness(F.col("age"), F.col("velocity"), F.col("side")).alias("freshness"), "score", S.grade(F.col("score")).alias("grade"),
    )


@query("SELECT side, grade, count(*) AS n FROM (SELECT side, " + _GRADE_SQL + " AS grade FROM (" + _SCORE_SQL + ")) GROUP BY ALL")
def q_grade_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by side and grade."""
    return scored(spark, sf_dir).groupBy("side", S.grade(F.col("score")).alias("grade")).agg(F.count("*").alias("n"))


_VALID_SQL = """SELECT *, CASE WHEN n_evidence < 2 THEN 'evidence,' ELSE '' END || CASE WHEN n_origins < 2 THEN 'sources,' ELSE '' END || CASE WHEN id % 13 = 0 THEN 'why_now,' ELSE '' END AS errs
  FROM (""" + _SCORE_SQL + ")"
_BUCKET_SQL = """SELECT id, side, score, rtrim(errs, ',') AS errors, CASE WHEN errs = '' AND score >= 70 AND rn <= 5 THEN 'pushable'
    WHEN errs = '' AND score >= CASE WHEN side = 'demand' THEN 60 ELSE 55 END THEN 'digest_only' WHEN errs = '' THEN 'passed' ELSE 'blocked' END AS bucket
  FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN errs = '' AND score >= 70 THEN 0 ELSE 1 END, score DESC, id) AS rn FROM (""" + _VALID_SQL + "))"


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scored(spark, sf_dir).withColumnRenamed("score", "final_score")
    dims = {n: F.col(f"d{i}") for i, n in enumerate(K.DIMENSIONS, 1)}
    why = F.when(F.col("id") % 13 != 0, "now").otherwise(" ")
    errors = gate.card_errors(F.lit("dev-tools"), dims, F.col("final_score"), F.col("n_evidence"), F.col("n_origins"), why, F.lit("build"))
    return gate.buckets(c.withColumn("errors", errors))


@query("SELECT id, score, errors, bucket FROM (" + _BUCKET_SQL + ")")
def q_gate_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each card's broken rules and its bucket; the push bucket is a top five."""
    return gated(spark, sf_dir).select("id", F.col("final_score").alias("score"), F.concat_ws(",", "errors").alias("errors"), "bucket")


@query("SELECT count(*) AS candidates, count(*) FILTER (WHERE bucket <> 'blocked') AS passed, count(*) FILTER (WHERE bucket = 'pushable') AS pushed, count(*) FILTER (WHERE bucket = 'digest_only') AS digest_only, count(*) FILTER (WHERE bucket IN ('pushable', 'digest_only')) = 0 AS empty_day FROM (" + _BUCKET_SQL + ")")
def q_run_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a run."""
    is_ = lambda *b: F.count_if(F.col("bucket").isin(*b))
    return gated(spark, sf_dir).agg(
        F.count("*").alias("candidates"), is_("pushable", "digest_only", "passed").alias("passed"), is_("pushable").alias("pushed"),
        is_("digest_only").alias("digest_only"), (is_("pushable", "digest_only") == 0).alias("empty_day"),
    )


@query("SELECT side, id, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY score DESC, id) AS rn FROM (" + _SCORE_SQL + ")) WHERE rn <= 10")
def q_topk_per_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best cards of either side, ranked apart."""
    ranked = pulse.per_side(scored(spark, sf_dir), 10, "score")
    return ranked.filter("rn <= 10").select("side", "id", "score", F.col("rn").cast("long").alias("rn"))


@query("SELECT side, count(*) FILTER (WHERE rn <= 10) AS shown, count(*) FILTER (WHERE rn > 10) AS overflow FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY score DESC, id) AS rn FROM (" + _SCORE_SQL + ")) GROUP BY side")
def q_headline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cards of a side the headlines show, and how many not."""
    n = scored(spark, sf_dir).groupBy("side").agg(F.count("*").alias("n"))
    return n.select("side", F.least("n", F.lit(10)).cast("long").alias("shown"), F.greatest(F.col("n") - 10, F.lit(0)).cast("long").alias("overflow"))


@query("""
SELECT o_custkey % 6 AS track, round(1.0 + sum(r), 6) AS alpha, round(1.0 + sum(1 - r), 6) AS beta, count(*) AS n, round((1.0 + sum(r)) / (2.0 + count(*)), 6) AS mean
FROM (SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN 0.0 WHEN o_totalprice >= 300000 THEN 1.0 WHEN o_totalprice >= 200000 THEN 0.6 ELSE floor(o_totalprice / 4000) / 100 END AS r FROM orders) GROUP BY ALL
""")
def q_bandit_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beta posteriors of six tracks from the outcomes of their orders; sums are associative, so no loop over cards."""
    from tidewatch.operators import bandit

    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    reward = S.outcome_reward(F.col("o_orderstatus") == "F", price >= 300000, price >= 200000, F.floor(price / 4000))
    outcomes = o.select((F.col("o_custkey") % 6).alias("track"), reward.alias("reward"))
    arms = spark.range(6).select(F.col("id").alias("track"), F.lit(1.0).alias("alpha"), F.lit(1.0).alias("beta"), F.lit(0).cast("long").alias("n"))
    out = bandit.fold_rewards(arms, outcomes)
    return out.withColumn("mean", F.round(bandit.posterior_mean(F.col("alpha"), F.col("beta")), 6))


@query()
def q_bandit_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reproducible Beta draws and exploration weights of the six tracks (CPython's generator, so no SQL twin)."""
    from tidewatch.operators import bandit

    arms = q_bandit_posterior(spark, sf_dir)
    drawn = arms.withColumn("theta", bandit.draw("2024-01-31", F.col("track").cast("string"), F.col("alpha"), F.col("beta")))
    return drawn.select("track", F.round("theta", 6).alias("theta"), bandit.explore_weight(F.col("theta")).alias("weight"))


_HAY = "lower(p_name || ' \n ' || p_type || ' ' || p_brand)"


def _count_sql(words: list[str], hay: str = "hay") -> str:
    return "(" + " + ".join(f"(contains({hay}, '{w}'))::INT" for w in words) + ")"


_CLASS_SQL = (
    "SELECT id, CASE WHEN b.n > 0 THEN b.t ELSE 'ai-agents' END AS track, b.n > 0 AS track_matched, types, coalesce(reason, '') AS reason FROM (SELECT doc_id AS id, list_max(["
    + ", ".join(f"{{'n': {_count_sql(words)}, 'w': {weight}::DOUBLE, 'o': {-i}, 't': '{name}'}}" for i, (name, weight, words) in enumerate(K.TRACKS))
    + "]) AS b, coalesce(nullif(array_to_string(list_sort(list_filter(["
    + ", ".join(f"CASE WHEN {_count_sql(words)} > 0 THEN '{name}' END" for name, words in K.MACHINE_TYPES.items())
    + "], lambda x: x IS NOT NULL)), ','), ''), 'tool-saas') AS types, CASE "
    + " ".join(f"WHEN contains(hay, '{x}') THEN '{x}'" for x in K.EXCLUDE)
    + " END AS reason FROM (SELECT doc_id, lower(left(text, 40) || ' \n ' || text) AS hay FROM documents))"
)


@query(_CLASS_SQL)
def q_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track, machine types and mute reason of each document, by keywords as substrings."""
    hay = classify.haystack(F.substring("text", 1, 40), F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", hay.alias("hay"))
    t = classify.track(F.col("hay"))
    return d.select(F.col("doc_id").alias("id"), t["track"].alias("track"), t["track_matched"].alias("track_matched"), F.array_join(classify.machine_types(F.col("hay")), ",").alias("types"), F.coalesce(classify.exclude_reason(F.col("hay")), F.lit("")).alias("reason"))


@query("SELECT d.lang, d.source, count(*) AS n_docs, count(l.doc_id) AS n_labelled, coalesce(sum(l.toxic), 0)::BIGINT AS n_toxic, coalesce(sum(l.quality), 0)::BIGINT AS n_good FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL")
def q_label_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by language and source."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels")
    joined = d.join(lab.withColumn("has", F.lit(1)), "doc_id", "left")
    return joined.groupBy("lang", "source").agg(F.count("*").alias("n_docs"), F.count("has").alias("n_labelled"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("n_toxic"), F.coalesce(F.sum("quality"), F.lit(0)).alias("n_good"))


_CONFIG = """'{"yield":{"floor":' || (c_custkey % 2) || ',"prune_after_weeks":' || (1 + c_custkey % 8) || ',"min_history_days":' || CASE WHEN c_custkey % 5 = 0 THEN '"x"' ELSE CAST(c_custkey % 10 AS STRING) END || ',"window_days":' || (20 + c_custkey % 40) || '},"sources":{"twitterapi":{"min_faves_rostered":' || (c_custkey % 700) || '},"forum":{"keep_nodes":' || CASE WHEN c_custkey % 3 = 0 THEN '"geek"' ELSE '["geek"]' END || '}}}'"""


@query("""
SELECT c_custkey AS id, array_to_string(list_filter([CASE WHEN c_custkey % 5 = 0 THEN 'yield.min_history_days no number' END, CASE WHEN c_custkey % 2 > 0 THEN 'yield.floor clamped' END, CASE WHEN 1 + c_custkey % 8 < 2 THEN 'yield.prune_after_weeks clamped' END,
  CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 10 < 7 THEN 'yield.min_history_days clamped' END, CASE WHEN 20 + c_custkey % 40 < greatest(30, 7 * greatest(2, 1 + c_custkey % 8)) THEN 'yield.window_days clamped' END,
  CASE WHEN c_custkey % 700 > 500 THEN 'min_faves_rostered clamped' END, CASE WHEN c_custkey % 3 = 0 THEN 'forum.keep_nodes no list of strings' END], lambda e: e IS NOT NULL), '; ') AS errors FROM customer
""")
def q_setting_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each of many configurations."""
    # Keys are few bytes and their configurations much work: a file of one row group would be one task.
    keys = table(spark, sf_dir, "customer").select("c_custkey").repartition(3 * spark.sparkContext.defaultParallelism)
    configs = keys.select(F.col("c_custkey").alias("id"), F.expr(_CONFIG).alias("config"))
    return configs.select("id", F.array_join(gate.setting_errors(F.col("config")), "; ").alias("errors"))
