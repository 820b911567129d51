"""The archive: its gate, the records of the cards that pass, and the ledger rows that records make."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import fixed as K
from tidewatch.functions import text as T

# The columns of a record in order, the column of a card each is from, its type and what it is where a card has none.
FIELDS = [
    ("opportunity_id", "opportunity_id", "string", None),
    ("canonical_key", "canonical_key", "string", ""),
    ("cluster_id", "cluster_id", "string", ""),
    ("first_seen", "first_seen", "timestamp", None),
    ("last_seen", "last_seen", "timestamp", None),
    ("status", "status", "string", "new"),
    ("title", "title", "string", ""),
    ("summary", "summary", "string", ""),
    ("track", "track", "string", None),
    ("focus_tags", "focus_tags", "array<string>", []),
    ("machine_type", "machine_type", "array<string>", []),
    ("score", "final_score", "double", None),
    ("grade", "grade", "string", None),
    ("score_breakdown", "score_breakdown", "map<string,double>", {}),
    ("why_now", "why_now", "string", ""),
    ("contrarian_insight", "contrarian_insight", "string", ""),
    ("action", "action", "string", ""),
    ("evidence", "evidence", "array<struct<source:string,url:string,ts:string>>", []),
    ("independent_source_count", "independent_source_count", "int", 0),
    ("pushed", "pushed", "boolean", False),
    ("push_count", "push_count", "bigint", 0),
    ("delegated_deepdive", "delegated_deepdive", "string", None),
    ("lifecycle_stage", "lifecycle_stage", "string", ""),
    ("run_id", "run_id", "string", ""),
    ("schema_version", "schema_version", "int", 1),
]
SCHEMA_VERSION = 1


def refusal(n_sources: Column, score: Column, min_sources: int = K.MIN_SOURCES, bar: float = K.ARCHIVE_BAR) -> Column:
    """Why the archive refuses a card: 'sources', else 'score', else null for one that it takes.

    Missing figures count as 0. A score that is no number is refused.
    """
    score = F.coalesce(score.cast("double"), F.lit(0.0))
    few = F.coalesce(n_sources.cast("int"), F.lit(0)) < min_sources
    return F.when(few, "sources").when(F.isnan(score) | (score < bar), "score")


def outcomes(cards: DataFrame, dry_run: bool = False, min_sources: int = K.MIN_SOURCES, bar: float = K.ARCHIVE_BAR) -> DataFrame:
    """cards with outcome ('refused', 'would-archive' in a dry run, else 'archived') and reason (null unless refused)."""
    why = refusal(F.col("independent_source_count"), F.col("final_score"), min_sources, bar)
    taken = "would-archive" if dry_run else "archived"
    return cards.withColumn("reason", why).withColumn("outcome", F.when(F.col("reason").isNotNull(), "refused").otherwise(taken))


def _filled(cards: DataFrame, source: str, kind: str, default) -> Column:
    """A card's column as its type, the default where it is null or the cards have no such column. Evidence keeps the fields it has."""
    if isinstance(default, (list, dict)):
        nothing = F.array() if isinstance(default, list) else F.create_map()
        empty = nothing.cast(cards.schema[source].dataType if source == "evidence" and source in cards.columns else kind)
    else:
        empty = F.lit(default).cast(kind)
    if source not in cards.columns:
        return empty
    value = F.col(source) if source == "evidence" else F.col(source).cast(kind)
    return F.coalesce(value, empty)


def records(cards: DataFrame, now: dt.datetime, run_id: str) -> DataFrame:
    """One record (FIELDS) a card, as of `now`; other columns of the cards are left out.

    A missing or empty opportunity_id is made from the key, a missing first_seen is now, last_seen is always now.
    """
    filled = {name: _filled(cards, source, kind, default) for name, source, kind, default in FIELDS}
    at = F.lit(now).cast("timestamp")
    filled["opportunity_id"] = F.coalesce(F.nullif(filled["opportunity_id"], F.lit("")), T.opportunity_id(filled["canonical_key"]))
    filled["first_seen"] = F.coalesce(filled["first_seen"], at)
    filled["last_seen"], filled["run_id"], filled["schema_version"] = at, F.lit(run_id), F.lit(SCHEMA_VERSION)
    return cards.select(*[filled[name].alias(name) for name, *_ in FIELDS])


def append_archive(cards: DataFrame, path: str, now: dt.datetime, run_id: str, dry_run: bool = False, min_sources: int = K.MIN_SOURCES, bar: float = K.ARCHIVE_BAR) -> DataFrame:
    """Appends the records of the cards that pass the archive's gate, and returns all cards with their outcome and reason.

    A run has a folder of its own under its date, so a run that is repeated takes the place of its first try and doubles nothing.
    A dry run has the same gate and writes nothing.
    """
    if not re.fullmatch(r"[A-Za-z0-9._-]+", run_id):
        raise ValueError(f"run_id {run_id!r} can't name a folder")
    judged = outcomes(cards, dry_run, min_sources, bar)
    if not dry_run:
        records(judged.filter("reason IS NULL"), now, run_id).write.mode("overwrite").parquet(f"{path}/date={now:%Y-%m-%d}/run={run_id}")
    return judged


def ledger_rows(recs: DataFrame) -> DataFrame:
    """Rows of the ledger's table (`ledger.ROW`) from records: a pushed card counts one push; sources are those of the evidence.

    Text is the title and the summary, of which the ledger keeps its first LEDGER_TEXT characters; tokens are those of what it keeps, the SimHash is of the whole.
    Two records of a key in a batch may both be given: the ledger's merge folds them.
    """
    text = F.concat_ws(" ", "title", "summary")
    sources = F.array_sort(F.array_distinct(F.array_compact(F.transform("evidence", lambda e: F.nullif(F.trim(e["source"]), F.lit(""))))))
    head = recs.withColumns({"__text": text, "__sources": sources})
    sample = F.struct(F.col("last_seen").alias("ts"), F.col("score"), F.coalesce(F.get("__sources", 0), F.lit("")).alias("source"))
    return head.select(
        "canonical_key", "opportunity_id", "cluster_id", F.when(F.col("cluster_id") != "", F.col("last_seen")).alias("cluster_at"), "first_seen", "last_seen", F.col("score").alias("last_score"), "lifecycle_stage",
        F.col("pushed").cast("long").alias("push_count"), F.col("__sources").alias("source_set"), T.simhash(F.col("__text")).alias("simhash"), F.col("__text").alias("text"),
        T.entities(F.substring("__text", 1, K.LEDGER_TEXT), 64).alias("toks"), F.array(sample).alias("samples"),
    )
