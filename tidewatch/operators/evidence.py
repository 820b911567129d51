"""Evidence of cards: the origins it credits, the item that stands for a card, and how its words are made fit to show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.operators.origins import is_community

# Names of tracks for readers, and the limits of a chat embed.
TRACK_NAMES = {"ai-agents": "AI", "fintech-crypto": "金融/加密", "dev-tools": "开发工具", "saas-niche": "SaaS", "consumer-social": "消费社交", "hardware-iot": "硬件"}
EMBED_TOTAL, EMBED_FIELDS, EMBED_VALUE = 6000, 25, 1024


def _said(c: Column) -> Column:
    """A text, or null where it is null or blank."""
    return F.when(F.trim(c) != "", c)


def evidence_origins(evidence: Column) -> Column:
    """array<struct<kind, name>>: the distinct accounts and sources of a card's items; an item may credit both."""
    handles = F.transform(evidence, lambda e: F.when(_said(e["origin_handle"]).isNotNull(), F.struct(F.lit("handle").alias("kind"), T.handle_key(e["origin_handle"]).alias("name"))))
    sources = F.transform(evidence, lambda e: F.when(_said(e["origin_source"]).isNotNull(), F.struct(F.lit("source").alias("kind"), F.lower(F.trim(e["origin_source"])).alias("name"))))
    return F.array_distinct(F.array_compact(F.concat(F.coalesce(handles, F.array()), F.coalesce(sources, F.array()))))


def pull_origin(handle: Column, source: Column) -> Column:
    """struct<kind, name> that a pull line accounts for: its account, else its source, else null."""
    by_handle = F.when(_said(handle).isNotNull(), F.struct(F.lit("handle").alias("kind"), T.handle_key(handle).alias("name")))
    return F.coalesce(by_handle, F.when(_said(source).isNotNull(), F.struct(F.lit("source").alias("kind"), F.lower(F.trim(source)).alias("name"))))


def record_time(last_seen: Column, first_seen: Column) -> Column:
    """When a record was last seen, else first; empty counts as missing."""
    return F.coalesce(F.nullif(last_seen, F.lit("")), F.nullif(first_seen, F.lit("")))


def opportunity_key(opportunity_id: Column, canonical_key: Column, row_id: Column) -> Column:
    """What a record is counted under: its opportunity, else its content key, else itself, so nothing unrelated is merged."""
    return F.coalesce(F.concat(F.lit("op:"), F.trim(_said(opportunity_id))), F.concat(F.lit("ck:"), F.trim(_said(canonical_key))), F.concat(F.lit("id:"), row_id.cast("string")))


def well_formed(evidence: Column) -> Column:
    """How many items have an address, a source and a time; 0 without evidence."""
    said = lambda c: F.coalesce(c.cast("string"), F.lit("")) != ""
    return F.coalesce(F.size(F.filter(evidence, lambda e: said(e["url"]) & said(e["source"]) & said(e["ts"]))), F.lit(0))


def representative(evidence: Column) -> Column:
    """The first community item of a card, else its first item, else null."""
    return F.coalesce(F.get(F.filter(evidence, lambda e: is_community(e)), 0), F.get(evidence, 0))


def shown_evidence(evidence: Column, most: int = 4) -> Column:
    return F.slice(evidence, 1, most)


def first_clean_url(evidence: Column) -> Column:
    """The first address of a card that can be linked to, or empty."""
    return F.coalesce(F.get(F.filter(F.transform(evidence, lambda e: T.clean_url(e["url"])), lambda u: u != ""), 0), F.lit(""))


def cell(s: Column) -> Column:
    """A value on one line that can't break a table: blanks collapsed, ` and | replaced."""
    flat = F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)\s+", " "))
    return F.translate(flat, "`|", "'/")


def inline(s: Column) -> Column:
    """A cell without long dashes."""
    return F.translate(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)\s+", " ")), r"\s*[–—―]+\s*", ", "), "`|", "'/")


def track_label(track: Column) -> Column:
    """A track's name for readers, else the track itself, else the word for others."""
    names = F.create_map(*[F.lit(x) for kv in TRACK_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.lower(F.trim(track))), F.nullif(inline(track), F.lit("")), F.lit("其他"))


def one_liner(signal: Column, why: Column, text: Column, summary: Column) -> Column:
    """Why an item is of interest: its signal, else its reason, else the first 120 characters of its text or summary."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    said = flat(F.coalesce(F.nullif(signal, F.lit("")), F.nullif(why, F.lit(""))))
    rest = F.coalesce(F.nullif(text, F.lit("")), summary)
    return F.when(said != "", said).otherwise(F.left(flat(rest), F.lit(120)))


def _strip(c: Column, where: str = r"(?U)\A\s+|\s+\z") -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), where, "")


def truncated(s: Column, cap: int) -> Column:
    """At most `cap` characters, cut after a sentence that ends in their second half, else cut there with an ellipsis."""
    s = _strip(s)
    head = F.left(s, F.lit(cap))
    kept = F.regexp_extract(head, r"(?s)^(.*(?:[。！？；]|[.!?] ))", 1)
    whole = F.when(F.length(kept) >= cap * 0.5, _strip(kept)).otherwise(F.concat(_strip(head, r"(?U)\s+\z"), F.lit("…")))
    return F.when(F.length(s) <= cap, s).otherwise(whole)


def embed_errors(title: Column, description: Column, footer: Column, fields: Column) -> Column:
    """array<string>: limits that an embed breaks; fields is array<struct<name, value>>."""
    n = lambda c: F.length(F.coalesce(c, F.lit("")))
    fields = F.coalesce(fields, F.array())
    total = n(title) + n(description) + n(footer) + F.aggregate(fields, F.lit(0), lambda a, f: a + n(f["name"]) + n(f["value"]))
    long = F.transform(F.filter(fields, lambda f: n(f["value"]) > EMBED_VALUE), lambda f: F.concat(F.lit("long value "), f["name"]))
    return F.concat(long, F.array_compact(F.array(F.when(F.size(fields) > EMBED_FIELDS, "too many fields"), F.when(total > EMBED_TOTAL, "too long"))))
