"""Queries of the corpus operators: thin views of each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import centroids, decontaminate, embeddings, html, language, licenses, packing, quality, sharding, simhash, substring, toxicity, whitening
from tidewatch.llm.common import text_bytes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op3_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    size = text_bytes() + 1
    rows = docs.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("tie"), *[c.alias(n) for n, c in sharding.text_dimensions().items()])
    dims = {n: F.col(n) for n in sharding.text_dimensions()}
    dealt = sharding.kd_shards(rows, dims, F.col("size"), F.col("tie"), 8)
    out = sharding.with_slots(dealt, "doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "n_template", "n_named", "n_outside")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_matches(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("template").alias("license"), "containment", "first_word")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = quality.with_quality(docs, quality.learn(docs, labels))
    score = F.col("quality_score")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("doc_key")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = toxicity.with_toxicity(docs, toxicity.learn(docs, labels))
    score = F.col("toxicity")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.with_language(docs.select("doc_id", "text"), language.learn(docs), score="score")
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.elkan_clusters(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an exact deviation beyond a long is null here; the operator has it as a decimal
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id").withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_substring_dedup, op2_embedding_near_dedup, op3_kd_sharding, op4_html_extraction, op5_license_scan, op6_simhash_near_dedup,
        op7_quality, op8_packing, op9_decontamination, op10_toxicity, op11_language_id, op12_centroid_clustering, op13_whitening,
        pipeline,
    )
    return {f.__name__: f for f in found}


_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ITEM_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_UP.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_SQL = {
    "op1_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 11, 1))) t(i)),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM g JOIN f USING (s) WHERE first < doc_id),
r AS (SELECT doc_id, list(pos) AS gone, count(*) AS n FROM c GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(array_to_string(list_filter(w, lambda x, i: NOT coalesce(list_contains(gone, i), false)), ' ')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)""",
    "op2_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(max(n.n), 0) AS n_links, min(r.b) AS component_id, v.vec_id = min(r.b) AS kept FROM v JOIN r ON r.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id GROUP BY v.vec_id""",
    "op9_decontamination": f"""
WITH w AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents), b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 8, 2))) t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM w, (SELECT DISTINCT n FROM bw), unnest(range(1, greatest(len(w) - n + 2, 1))) t(i)),
h AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN bw USING (s, n)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
k AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS names FROM h GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN k USING (doc_id)""",
}


def _rounds(k: int = 8, rounds: int = 10) -> str:
    """The rounds of op12, one after another; // rounds towards zero, so the remainder is made positive first."""
    steps = [
        f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, x FROM v ORDER BY c LIMIT {k})"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, v.x, c, list_sum(list_transform(list_zip(v.x, c{i}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i}
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT c, j, sum(x[j]) AS s, count(*) AS n FROM a{i}, range(1, 65) t(j) GROUP BY c, j),
m{i} AS (SELECT c, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY j) AS x FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (c))""")
    return ",\n".join(steps) + f"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""


def oracle_sql() -> dict[str, str]:
    """SQL twins of the queries that SQL can express over whole tables; tests hold the others against brute force."""
    return _SQL | {"op12_centroid_clustering": _rounds()}
