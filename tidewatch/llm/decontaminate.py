"""Operator 9: benchmark decontamination by winnowing, in DataFrame functions only.

Every window of `window` words keeps one fingerprint, the least hash of the word grams inside it; equal
windows have equal fingerprints, so each shared span of a window or more is met. Fingerprints of the documents join
those of the benchmark, and each meeting is extended to the window's words and compared as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import written

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 50_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """A-Z lower-cased, then the words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`; null has none."""
    plain = F.octet_length(text) == F.char_length(text)  # ASCII: lower() changes A-Z alone, and faster
    folded = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.array_remove(F.split(F.coalesce(folded, F.lit("")), BREAKS), "")


def _gram_of(k: int):
    return lambda h, i: F.xxhash64(h, *[F.get("hashes", i + j) for j in range(1, k)])


def _least_of(grams: str, spread: int):
    return lambda g, i: F.least(g, *[F.get(grams, i + j) for j in range(1, spread)]) if spread > 1 else g


def _placed(length: int):
    return lambda p, i: F.struct(F.lit(length).alias("length"), i.alias("at"), p.alias("print"))


def _window_prints(df: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """df with a column `prints_<length>` for each length: the print of each window of `words`, in order.

    The words are hashed once for all lengths. A print is the least hash of the grams inside a window.
    """
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    for length in lengths:
        k = min(gram, length)
        spread = length - k + 1
        many = F.greatest(F.size("hashes") - (k - 1), F.lit(0))
        grams = f"grams_{k}"
        if grams not in df.columns:
            df = df.withColumn(grams, F.transform(F.slice("hashes", F.lit(1), many), _gram_of(k)))
        many = F.greatest(F.size(grams) - (spread - 1), F.lit(0))
        df = df.withColumn(f"prints_{length}", F.transform(F.slice(grams, F.lit(1), many), _least_of(grams, spread)))
    return df.drop("hashes", *{f"grams_{min(gram, n)}" for n in lengths})


def _places(df: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """Rows (keep, length, at, print) of the windows that `_window_prints` has found."""
    # the outer explodes: for the plain ones Spark adds a filter on the array, which would compute it twice over
    if len(lengths) == 1:
        return df.select(*keep, F.lit(lengths[0]).alias("length"), F.posexplode_outer(f"prints_{lengths[0]}").alias("at", "print"))
    every = F.array(*[F.transform(f"prints_{n}", _placed(n)) for n in lengths])
    return df.select(*keep, F.inline_outer(F.flatten(every)))


def _window_text() -> Column:
    return F.concat_ws(" ", F.slice("words", F.col("at") + 1, F.col("length")))


def benchmark_hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", window: int = 10, gram: int = 4) -> DataFrame:
    """(doc_key, at, length, item): each occurrence of an item's window in a document, at a word position.

    doc_key is struct<id, print of the text>, so rows that repeat an id with other text stay apart. An item
    shorter than a window, but not empty, is one window. All lengths of windows are looked for in one pass. The items'
    windows are broadcast only if there are at most BROADCAST_ROWS of them; else both sides are shuffled on the fingerprint.
    """
    key = F.struct(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("print")).alias("doc_key")
    documents = docs.select(key, words_of(F.col(text_col)).alias("words"))
    tests = items.select(F.col(item_id).alias("item"), words_of(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    lengths = sorted(r[0] for r in tests.select(F.least(F.size("words"), F.lit(window)).alias("n")).distinct().collect())  # at most `window` numbers
    if not lengths:
        return documents.select("doc_key", F.lit(0).alias("at"), F.lit(0).alias("length"), F.lit(None).cast(items.schema[item_id].dataType).alias("item")).limit(0)
    own = _places(_window_prints(tests, lengths, gram), lengths, ["item", "words"]).filter(F.col("length") == F.least(F.size("words"), F.lit(window)))
    own = written(own.select("length", "print", _window_text().alias("span"), "item").distinct(), "benchmark-windows")
    prints = own.select("length", "print").distinct()
    small = own.count() <= BROADCAST_ROWS
    place = _places(_window_prints(documents, lengths, gram), lengths, ["doc_key", "words"])
    met = place.join(F.broadcast(prints) if small else prints, ["length", "print"]).select("doc_key", "at", "length", _window_text().alias("span"))
    spans = own.select("span", "length", "item")
    return met.join(F.broadcast(spans) if small else spans, ["span", "length"]).select("doc_key", "at", "length", "item")


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", window: int = 10) -> DataFrame:
    """Every document row (doc_id, text print) with n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits. A null document id is reported like any other. Rows
    that repeat an id and a text get the same figures each; rows that repeat an id with other text get their own. An
    empty table stays empty.
    """
    hits = benchmark_hits(docs, items, doc_id, item_id, text_col, window)
    # One row for each document, position and length; with the items, which are few for any window.
    spots = hits.groupBy("doc_key", "at").agg(F.max("length").alias("length"), F.collect_set(F.col("item").cast("string")).alias("items"))
    by_doc = Window.partitionBy("doc_key").orderBy("at")
    spots = spots.withColumn("end", F.col("at") + F.col("length"))
    spots = spots.withColumn("before", F.coalesce(F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    spots = spots.withColumn("new", F.greatest(F.col("end") - F.greatest("at", "before"), F.lit(0)))
    figures = spots.groupBy("doc_key").agg(F.sum("new").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    base = docs.select(F.col(doc_id), F.struct(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("print")).alias("doc_key"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    joined = base.join(figures.withColumnRenamed("doc_key", "hit_key"), F.col("doc_key").eqNullSafe(F.col("hit_key")), "left")
    n_hit, names = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        F.col(doc_id),
        "doc_key",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
