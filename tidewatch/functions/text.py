"""Tokens, keys, SimHash, Jaccard, shingles and URLs as Column functions."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidewatch.functions import fixed as K


#: Tokens in group 1; ASCII ones of one or two characters match too, with an empty group.
_KEPT = K.TOKEN.replace("*", "{2,}+", 1)
_KEPT = f"({_KEPT})|[a-z0-9][a-z0-9+.#-]?+"


def once(value: Column, f) -> Column:
    """f(value) with the value made once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _raw_tokens(text: Column) -> Column:
    """Tokens of a text in order, stop words and empty ones for the too short among them."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_KEPT), 1)


def _folded(found: Column) -> Column:
    """Tokens with aliases folded; most texts have none, and are left as they are."""
    alias = F.create_map(*[F.lit(x) for kv in K.ALIAS.items() for x in kv])
    names = F.array(*[F.lit(x) for x in K.ALIAS])
    return once(found, lambda v: F.when(F.arrays_overlap(v, names), F.transform(v, lambda t: F.coalesce(F.try_element_at(alias, t), t))).otherwise(v))


def tokens(text: Column) -> Column:
    """All tokens of a text in order: lower-cased; ASCII ones under three characters and stop words left out; aliases folded."""
    return _folded(F.filter(_raw_tokens(text), lambda t: ~t.isin("", *K.STOP)))


def entities(text: Column, most: int = 8) -> Column:
    """The first `most` distinct tokens, in order."""
    distinct = F.array_except(_raw_tokens(text), F.array(*[F.lit(w) for w in ("", *K.STOP)]))
    return F.slice(F.array_distinct(_folded(distinct)), 1, most)


def slug(name: Column) -> Column:
    """Trimmed and lower-cased, aliases folded; null is empty."""
    alias = F.create_map(*[F.lit(x) for kv in K.ALIAS.items() for x in kv])
    bare = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.coalesce(F.try_element_at(alias, bare), bare)


def canonical_key(names: Column, track: Column) -> Column:
    """Sorted distinct slugs of the entities joined by | and the slug of the track; an empty list gives '::track'."""
    kept = F.filter(names, lambda e: e != "")
    return F.concat(F.concat_ws("|", F.array_sort(F.array_distinct(F.transform(kept, slug)))), F.lit("::"), slug(track))


def opportunity_id(key: Column) -> Column:
    return F.concat(F.lit("op-"), F.substring(F.sha1(key), 1, 16))


def hash64(token: Column) -> Column:
    """First eight bytes of the MD5, as a signed 64-bit number."""
    return F.conv(F.substring(F.md5(token), 1, 16), 16, -10).cast("long")


def _majority(lists: pd.Series, most: int = 1 << 18) -> np.ndarray:
    """Majority votes of the token hashes of each list, as unsigned 64-bit numbers; about `most` tokens at a time.

    Stop words and empty tokens have no vote, aliases that of what they stand for.
    """
    known = dict.fromkeys(("", *K.STOP), 0)
    words = [""]
    for alias, name in K.ALIAS.items():
        if name not in known:
            known[name] = len(words)
            words.append(name)
        known[alias] = known[name]

    def code(token: str) -> int:
        at = known.get(token)
        if at is None:
            at = known[token] = len(words)
            words.append(token)
        return at

    every = np.fromiter((code(t) for x in lists if x is not None for t in x), np.int64)
    owner = np.repeat(np.arange(len(lists)), lists.map(lambda x: 0 if x is None else len(x)).to_numpy())[every > 0]
    codes, sizes = every[every > 0], np.bincount(owner, minlength=len(lists))
    raw = b"".join(md5(t.encode("utf-8", "surrogatepass")).digest()[:8] for t in words)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
    ends = np.cumsum(sizes)
    starts, some = ends - sizes, np.flatnonzero(sizes)
    out = np.zeros((len(lists), 64), bool)
    at = 0
    while at < len(some):
        # at least one row, and as many more as fit
        to = max(at + 1, int(np.searchsorted(ends[some], starts[some[at]] + most, side="right")))
        rows, low, end = some[at:to], starts[some[at]], ends[some[to - 1]]
        if len(rows) == 1:
            votes = sum(bits[codes[piece : min(piece + most, end)]].sum(axis=0, dtype=np.int64) for piece in range(low, end, most))[None]
        else:
            votes = np.add.reduceat(bits[codes[low:end]], starts[rows] - low, axis=0, dtype=np.int64)
        out[rows] = 2 * votes > sizes[rows][:, None]
        at = to
    return np.packbits(out, axis=1).view(">u8").astype(np.uint64).ravel()


@F.pandas_udf(LongType())
def _votes(lists: pd.Series) -> pd.Series:
    return pd.Series(_majority(lists).view(np.int64))


def simhash(text: Column) -> Column:
    """The SimHash of a text's tokens by majority votes over every occurrence; a text without tokens has 0."""
    return _votes(_raw_tokens(text))


def simhash64(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, simhash) of every row.

    A row needs nothing but its own tokens, so nothing is shuffled: Arrow batches of tokens go in, a number a row comes out.
    """
    return docs.select(id_col, simhash(text).alias("simhash"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / union).otherwise(0.0)


def subjects_agree(a: Column, b: Column) -> Column:
    """Either side empty, one within the other, or the same first entity."""
    return (F.size(a) == 0) | (F.size(b) == 0) | (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0) | (F.get(a, 0) == F.get(b, 0))


def prose_words(text: Column) -> Column:
    """Lower-case words of prose: fences, table rows, link targets and markup marks taken out, words without letters dropped."""
    # what a pattern cannot do without is looked for first: most texts have none of it
    plain = F.when(text.contains("```"), F.regexp_replace(text, r"(?s)```.*?```", " ")).otherwise(text)
    plain = once(plain, lambda t: F.when(t.contains("|"), F.regexp_replace(t, r"(?m)^\s*\|.*\|\s*$", " ")).otherwise(t))
    plain = once(plain, lambda t: F.when(t.contains("]("), F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")).otherwise(t))
    plain = F.translate(plain, "`*_#>", "     ")
    return F.filter(F.split(F.lower(plain), r"\s+"), lambda w: w.rlike(r"\p{L}"))


def shingles(words: Column, n: int = K.SHINGLE_WORDS) -> Column:
    """All runs of n words; fewer words give none."""
    count = F.size(words) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(words, i, n)))).otherwise(F.array().cast("array<string>"))


def clean_url(url: Column) -> Column:
    """An http(s) address without blanks or angle brackets, else empty."""
    url = F.trim(F.coalesce(url, F.lit("")))
    return F.when(url.rlike(r"^https?://[^\s<>]+$"), url).otherwise("")


def pulse_key(url: Column, title: Column) -> Column:
    """'u:' and the address without fragment, query and last slashes; else 't:' and the title; else empty."""
    bare = F.regexp_replace(F.split_part(F.split_part(F.lower(F.trim(F.coalesce(url, F.lit("")))), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)), "/+$", "")
    name = F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\s+", " "))
    return F.when(bare != "", F.concat(F.lit("u:"), bare)).when(name != "", F.concat(F.lit("t:"), name)).otherwise("")


HANDLE = "^[A-Za-z0-9_]{1,15}$"


def bare_handle(handle: Column) -> Column:
    """Trimmed, one leading @ taken off."""
    return F.regexp_replace(F.trim(handle), "^@", "")


def handle_key(handle: Column) -> Column:
    """Trimmed, one leading @ taken off, lower-cased."""
    return F.lower(bare_handle(handle))


def iso_week(ts: Column) -> Column:
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts).cast("int"), F.extract(F.lit("WEEK"), ts).cast("int"))


def char_entropy(token: Column) -> Column:
    """Shannon entropy of the characters, rounded to nine places."""
    chars = F.split(token, "")
    kinds = F.array_distinct(chars)
    n = F.length(token).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.round(-F.aggregate(kinds, F.lit(0.0), lambda acc, c: acc + share(c) * F.log2(share(c))), 9)
