"""From raw documents to packed training sequences, as stages that are each written as a table.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and calls one operator.
All but the last return the columns of documents. Toxic and contaminated documents go, of near duplicates the
smallest id stays, and repeated passages are cut out of the later documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, near_text, packing, substring, toxicity
from tidewatch.llm.common import discard, scope, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC = 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under TOXIC. The lexicon is learned from the raw tables' labels."""
    lexicon = toxicity.learn(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return toxicity.with_toxicity(docs.select(*COLUMNS), lexicon).filter(F.col("toxicity") < TOXIC).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles.

    Candidates come from op6's Golay keys of five-word fingerprints and from MinHash bands, and are verified on whole sets.

    Documents without words or id all stay. Rows that repeat an id go by their own texts; of rows that repeat id and
    text, one stays.
    """
    docs = docs.select(*COLUMNS).withColumn("__print", F.xxhash64("text"))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]") & F.col("doc_id").isNotNull()
    groups = near_text.near_text_groups(docs.filter(worded))
    rows = written(groups.groupBy(F.col("id").alias("doc_id"), F.col("print").alias("__print")).agg(F.bool_and("first").alias("first"), F.count("*").alias("n")), "near-groups")
    kept = docs.join(rows.filter("NOT first OR n > 1"), ["doc_id", "__print"], "left_anti")
    twice = rows.filter("first AND n > 1")
    if not twice.isEmpty():
        kept = kept.unionByName(docs.join(twice, ["doc_id", "__print"], "left_semi").dropDuplicates(["doc_id", "__print"]))
    return kept.select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a smaller id has too; documents of which nothing is left go."""
    found = substring.remove_repeats(docs.select(*COLUMNS)).filter("n_removed = 0 OR n_removed < n_words")
    text = F.col("kept_text")
    length = F.when(F.col("n_removed") > 0, F.char_length(text).cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", text.alias("text"), "lang", "source", length.alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    docs = docs.select(*COLUMNS)
    hits = decontaminate.benchmark_hits(docs, _table(spark, sf_dir, "benchmark"))
    found = hits.select(F.col("doc_key.id").alias("hit_id"), F.col("doc_key.print").alias("hit_print")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(found["hit_id"]) & (F.xxhash64(docs["text"]) == found["hit_print"])
    return docs.join(found, same, "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of powers of two up to 2048 tokens, with their token ids."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No stage but decontamination can be said in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a Parquet table in the shared folder, reread by the next.

    A stage's own tables are deleted once its result is written.
    """
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scope(spark) as keep:
            docs = keep(written(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
