"""Findings and their first places, trees of files against manifests, and what a reader is shown of a card."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import fixed as K
from tidewatch.operators import evidence, privacy
from tidewatch.plans.catalog import query, table


@query("""
SELECT event_type AS label, arg_min(v, event_id) AS value, severity, 'f' || min(event_id) % 1000 AS "where" FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'V' ELSE 'v' END || user_id % 50 AS v, CASE user_id % 3 WHEN 0 THEN 'BLOCK' ELSE 'WARN' END AS severity FROM events)
GROUP BY event_type, lower(v), severity
""")
def q_first_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finding once, at its first place and as it is written there; values are equal without regard to case."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    found = e.select(
        F.col("event_type").alias("label"), F.concat(F.when(n % 2 == 0, "V").otherwise("v"), F.col("user_id") % 50).alias("value"), F.when(F.col("user_id") % 3 == 0, "BLOCK").otherwise("WARN").alias("severity"),
        F.concat(F.lit("f"), n % 1000).alias("where"), n.alias("pos"),
    )
    return privacy.first_findings(found)


@query("""
WITH f AS (SELECT 'd' || page_id % 97 AS dir, 'd' || page_id % 97 || '/f' || page_id AS stem, page_id FROM pages), t AS (SELECT dir, stem || '.jsonl' AS path FROM f UNION ALL SELECT dir, stem || CASE page_id % 3 WHEN 0 THEN '.jsonl.example' ELSE '.example.jsonl' END FROM f WHERE page_id % 3 < 2)
SELECT DISTINCT 'DATA-TRACKED' AS kind, path FROM t WHERE dir IN (SELECT dir FROM f WHERE page_id % 10 = 0) OR path IN (SELECT stem || '.jsonl' FROM f WHERE page_id % 4 = 1)
UNION ALL SELECT 'NO-SCHEMA', stem || '.jsonl.example' FROM f WHERE page_id % 4 = 1 AND page_id % 3 = 2
""")
def q_manifest_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a tree that its manifest declares as data or sealed, and declared files without an example beside them."""
    n = F.col("page_id")
    stem = F.concat(F.lit("d"), n % 97, F.lit("/f"), n)
    p = table(spark, sf_dir, "pages").select(n, F.concat(F.lit("d"), n % 97).alias("dir"), stem.alias("stem"))
    example = F.when(n % 3 == 0, F.concat("stem", F.lit(".jsonl.example"))).when(n % 3 == 1, F.concat("stem", F.lit(".example.jsonl")))
    files = p.select(F.explode(F.array_compact(F.array(F.concat("stem", F.lit(".jsonl")), example))).alias("path"))
    sealed = p.filter(n % 10 == 0).select(F.concat("dir", F.lit("/")).alias("path"), F.lit("sealed").alias("kind"))
    data = p.filter(n % 4 == 1).select(F.concat("stem", F.lit(".jsonl")).alias("path"), F.lit("data").alias("kind"))
    return privacy.manifest_findings(files, sealed.unionByName(data))


@query("""
SELECT 'p' || doc_id AS path, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 10 = 0 THEN 'extra' ELSE 'differs' END AS state FROM documents WHERE (doc_id % 11 = 0) <> (doc_id % 10 = 0) OR (doc_id % 7 = 0 AND doc_id % 11 <> 0 AND doc_id % 10 <> 0)
""")
def q_fixture_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated files against those found: a tenth is not made, an eleventh is missing, a seventh changed, half have other line ends."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("p"), "doc_id").alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit("\nend\n")).alias("content"))
    other = F.when(F.col("doc_id") % 2 == 0, F.replace("content", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("content"))
    found = d.filter("doc_id % 11 <> 0").withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("x"))).otherwise(other))
    return privacy.fixture_differences(d.filter("doc_id % 10 <> 0"), found)


@query("SELECT c_custkey AS name FROM customer WHERE c_custkey % 3 < 2 AND c_custkey % 5 < 2")
def q_unaudited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests that declare no data and give no reason."""
    n = F.col("c_custkey")
    data = F.when(n % 3 == 0, F.array().cast("array<string>")).when(n % 3 == 2, F.array(F.lit("x.jsonl")))
    return privacy.unaudited(table(spark, sf_dir, "customer").select(n.alias("name"), data.alias("data"), F.when(n % 5 == 0, "  ").when(n % 5 > 1, "none kept").alias("audited"))).select("name")


_FORUM = K.COMMUNITY_SOURCES[0]


@query(f"""
WITH i AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn, l_linenumber AS n, CASE WHEN l_partkey % 3 = 0 THEN 'not a link' ELSE 'http://p/' || l_partkey END AS url, l_suppkey % 4 = 0 AS forum FROM lineitem)
SELECT id, array_to_string(list(n ORDER BY n) FILTER (WHERE rn <= 4), ',') AS shown, coalesce(min(n) FILTER (WHERE forum), min(n))::INT AS chosen, coalesce((list(url ORDER BY n, url) FILTER (WHERE url LIKE 'http%'))[1], '') AS first_url FROM i GROUP BY id
""")
def q_shown_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four items of each card, the item that stands for it in the rumour lane and its first address that can be linked to."""
    blank = F.lit(None).cast("string")
    item = F.struct(
        F.col("l_linenumber").cast("int").alias("n"), F.when(F.col("l_partkey") % 3 == 0, "not a link").otherwise(F.concat(F.lit("http://p/"), "l_partkey")).alias("url"),
        F.when(F.col("l_suppkey") % 4 == 0, _FORUM).alias("origin_source"), blank.alias("source"), blank.alias("origin"),
    )
    cards = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    e = F.col("evidence")
    return cards.select("id", F.concat_ws(",", evidence.shown_evidence(e)["n"].cast("array<string>")).alias("shown"), evidence.representative(e)["n"].alias("chosen"), evidence.first_clean_url(e).alias("first_url"))


_FLAT = r"trim(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g'))"


@query(rf"""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'signal ' || doc_id WHEN doc_id % 3 = 1 AND doc_id % 2 = 0 THEN 'why' ELSE left({_FLAT.format('text')}, 120) END AS line, array_to_string(list_filter([CASE WHEN length(text) > 1024 THEN 'long value text' END, CASE WHEN doc_id % 30 > 24 THEN 'too many fields' END,
  CASE WHEN 3 + length(coalesce(text, '')) * 2 + 4 + doc_id % 30 * 2 > 6000 THEN 'too long' END], lambda e: e IS NOT NULL), '; ') AS errors FROM documents
""")
def q_one_liners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each item by its fallbacks, and the limits that a message with its text would break."""
    n, text = F.col("doc_id"), F.col("text")
    line = evidence.one_liner(F.when(n % 3 == 0, F.concat(F.lit("signal  "), n)), F.when(n % 3 == 1, F.when(n % 2 == 0, " why ").otherwise("")), F.when(n % 5 != 0, text).otherwise(""), text)
    small = F.array_repeat(F.struct(F.lit("a").alias("name"), F.lit("b").alias("value")), (n % 30).cast("int"))
    errors = evidence.embed_errors(F.lit("abc"), text, F.lit(""), F.concat(small, F.array(F.struct(F.lit("text").alias("name"), F.coalesce(text, F.lit("")).alias("value")))))
    return table(spark, sf_dir, "documents").select("doc_id", line.alias("line"), F.array_join(errors, "; ").alias("errors"))
