"""Keys, SimHash and ledger matches of documents: even ids are the ledger, odd ones the candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import fixed as K
from tidewatch.functions import text as T
from tidewatch.operators import dedup
from tidewatch.plans.catalog import query, table

_STOP = "[" + ", ".join(f"'{w}'" for w in K.STOP) + "]"
_ALIAS = "CASE t " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in K.ALIAS.items()) + " ELSE t END"
# Tokens in order; DuckDB's regular expressions know the scripts by name.
_TOKENS = (
    "list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+.#-]*|[\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}]+'), "
    f"lambda t: NOT (length(t) < 3 AND regexp_full_match(t, '[\\x00-\\x7F]*')) AND NOT list_contains({_STOP}, t)), lambda t: {_ALIAS})"
)
# Order-preserving distinct: the first place of each token.
_DISTINCT = "list_filter(toks, lambda x, i: list_position(toks, x) = i)"
_HEAD = f"SELECT doc_id, text, source, {_TOKENS} AS toks FROM documents"


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their key entities, first 64 tokens, track and key, all of the whole text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text").withColumn("toks", T.entities(F.col("text"), 64))
    return d.select("doc_id", "source", "text", F.slice("toks", 1, 8).alias("ents"), "toks", F.col("source").alias("track")).withColumn("canonical_key", T.canonical_key(F.col("ents"), F.col("track")))


@query(f"SELECT doc_id, array_to_string({_DISTINCT}[1:8], ' ') AS entities, len(toks) AS n_tokens FROM ({_HEAD})")
def q_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight distinct entities of each document, and how many tokens it has."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("toks"))
    return d.select("doc_id", F.array_join(F.slice(F.array_distinct("toks"), 1, 8), " ").alias("entities"), F.size("toks").cast("long").alias("n_tokens"))


@query(f"SELECT doc_id, k AS canonical_key, 'op-' || left(sha1(k), 16) AS opportunity_id FROM (SELECT doc_id, array_to_string(list_sort({_DISTINCT}[1:8]), '|') || '::' || lower(trim(source)) AS k FROM ({_HEAD}))")
def q_canonical_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content key and opportunity id of each document."""
    return keyed(spark, sf_dir).select("doc_id", "canonical_key", T.opportunity_id(F.col("canonical_key")).alias("opportunity_id"))


_SIM = f"""SELECT doc_id, coalesce(bit_or(CASE WHEN vote > 0 THEN 1::UBIGINT << b ELSE 0::UBIGINT END), 0) AS h FROM (
  SELECT doc_id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN 1 ELSE -1 END) AS vote FROM (SELECT doc_id, ('0x' || left(md5(t), 16))::UBIGINT AS h FROM (SELECT doc_id, unnest(toks) AS t FROM ({_HEAD}))), (SELECT unnest(range(64))::UBIGINT AS b) GROUP BY ALL) GROUP BY ALL"""


@query(f"SELECT d.doc_id, lpad(to_hex(coalesce(h, 0::UBIGINT)), 16, '0') AS simhash FROM documents d LEFT JOIN ({_SIM}) USING (doc_id)".replace("to_hex", "lower(to_hex").replace("UBIGINT))", "UBIGINT)))"))
def q_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit SimHash of each document over the MD5 of its tokens."""
    s = T.simhash64(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    return s.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("simhash"))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(candidates, ledger) with entities, keys and SimHashes of whole texts.

    A ledger row stores the first 400 characters of its text (K.LEDGER_TEXT), and its tokens are those of what it stores;
    a candidate's are those of its whole text.
    """
    hashed = keyed(spark, sf_dir).withColumn("simhash", T.simhash(F.col("text")))
    cands = hashed.filter("doc_id % 2 = 1").withColumnRenamed("doc_id", "cand_id").drop("text")
    stored = F.substring("text", 1, K.LEDGER_TEXT)
    ledger = hashed.filter("doc_id % 2 = 0").withColumnRenamed("doc_id", "pos").withColumn("text", stored).withColumn("toks", T.entities(F.col("text"), 64))
    return cands, ledger


_KEYED = f"SELECT a.doc_id, a.source, {_DISTINCT}[1:8] AS ents, CASE WHEN a.doc_id % 2 = 1 THEN {_DISTINCT}[1:64] ELSE list_filter(stored, lambda x, i: list_position(stored, x) = i)[1:64] END AS top FROM ({_HEAD}) a JOIN (SELECT doc_id, toks AS stored FROM ({_HEAD.replace('lower(text)', 'lower(left(text, 400))')})) USING (doc_id)"
_MATCH = f"""
WITH k AS (SELECT k.*, array_to_string(list_sort(ents), '|') || '::' || lower(trim(source)) AS ckey, coalesce(h, 0::UBIGINT) AS h FROM ({_KEYED}) k LEFT JOIN ({_SIM}) USING (doc_id)),
c AS (SELECT * FROM k WHERE doc_id % 2 = 1), r AS (SELECT * FROM k WHERE doc_id % 2 = 0),
exact AS (SELECT c.doc_id AS cand_id, min(r.doc_id) AS row_pos FROM c JOIN r USING (ckey) GROUP BY ALL),
p AS (SELECT c.doc_id AS cand_id, r.doc_id AS row_pos, len(list_intersect(c.ents, r.ents)) AS shared, c.source = r.source AS same_track, bit_count(xor(c.h, r.h)) AS ham, r.h AS rh,
  CASE WHEN len(c.top) > 0 AND len(r.top) > 0 THEN len(list_intersect(c.top, r.top)) / len(list_distinct(list_concat(c.top, r.top))) ELSE 0 END AS sim,
  len(c.top) = 0 OR len(r.top) = 0 OR len(list_intersect(c.top, r.top)) IN (len(c.top), len(r.top)) OR c.top[1] = r.top[1] AS subj
  FROM c, r WHERE c.doc_id NOT IN (SELECT cand_id FROM exact)),
soft AS (SELECT cand_id, arg_max(row_pos, {{'s': sim, 'p': row_pos}}) AS row_pos FROM p WHERE sim >= 0.83 OR ((shared >= 2 OR (shared >= 1 AND same_track)) AND subj AND ((rh <> 0 AND ham <= 3) OR sim >= 0.45)) GROUP BY ALL)
SELECT cand_id, row_pos, 'exact' AS how FROM exact UNION ALL SELECT cand_id, row_pos, 'soft' AS how FROM soft"""


@query(_MATCH)
def q_ledger_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger row that each candidate matches: by key, else by similarity, found by blocking and held against all pairs."""
    c, r = sides(spark, sf_dir)
    return dedup.matches(c, r)


_STATE = "SELECT doc_id, n_chars % 101 AS score, CASE n_chars % 4 WHEN 0 THEN 'emerging' WHEN 1 THEN 'peak' WHEN 2 THEN 'fading' ELSE '' END AS stage, CASE WHEN n_chars % 3 = 0 THEN [source] ELSE [source, lang] END AS sources FROM documents"


@query(f"""
WITH m AS ({_MATCH}), s AS ({_STATE})
SELECT c.doc_id AS cand_id, CASE WHEN m.row_pos IS NULL THEN 'NEW' WHEN (c.stage <> '' AND c.stage <> r.stage) OR abs(c.score - r.score) >= 15
  OR (len(list_filter(c.sources, lambda x: NOT list_contains(r.sources, x))) > 0 AND len(r.sources) < 2 AND len(c.sources) >= 2) THEN 'RESURFACE' ELSE 'SUPPRESS' END AS branch
FROM s c LEFT JOIN m ON m.cand_id = c.doc_id LEFT JOIN s r ON r.doc_id = m.row_pos WHERE c.doc_id % 2 = 1
""")
def q_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NEW, SUPPRESS or RESURFACE for each candidate, against the ledger as it was before the batch."""
    found = q_ledger_match(spark, sf_dir)
    n = F.col("n_chars")
    state = table(spark, sf_dir, "documents").select(
        "doc_id", (n % 101).cast("double").alias("score"), F.when(n % 4 == 0, "emerging").when(n % 4 == 1, "peak").when(n % 4 == 2, "fading").otherwise("").alias("stage"),
        F.when(n % 3 == 0, F.array("source")).otherwise(F.array("source", "lang")).alias("sources"),
    )
    c = state.filter("doc_id % 2 = 1").withColumnRenamed("doc_id", "cand_id")
    r = state.select(F.col("doc_id").alias("row_pos"), *[F.col(x).alias(f"prev_{x}") for x in ("score", "stage", "sources")])
    j = c.join(found, "cand_id", "left").join(r, "row_pos", "left")
    b = dedup.branch(F.col("row_pos").isNotNull(), F.col("stage"), F.col("prev_stage"), F.col("score"), F.col("prev_score"), F.col("sources"), F.coalesce("prev_sources", F.array().cast("array<string>")))
    return j.select("cand_id", b.alias("branch"))
