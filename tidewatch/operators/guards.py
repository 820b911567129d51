"""Text guards: personal data, secrets, dashes, duplicated prose, paths and a denylist."""

from __future__ import annotations

import hmac
import math
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import fixed as K
from tidewatch.functions import text as T
from tidewatch.sources.shared import kept

_U = "(?U)"
REDACTED = "struct<redacted: string, found: map<string, int>>"


def pii_counts(text: Column) -> dict[str, Column]:
    """Native counts of what needs no order: addresses, links and numbers."""
    return {name: F.regexp_count(text, F.lit(_U + pattern)) for name, pattern in (("emails", K.EMAIL), ("ipv4", K.IPV4), ("urls", K.URL), ("mentions", K.MENTION), ("ids", K.SNOWFLAKE))}


def luhn_cards(text: Column) -> Column:
    """Digit strings of 13 to 19 digits that pass the Luhn check."""
    runs = F.regexp_extract_all(text, F.lit(f"({K.CARD})"), 1)
    digits = F.transform(runs, lambda r: F.regexp_replace(r, r"\D", ""))
    return F.filter(digits, lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d))


def secret_tokens(text: Column) -> Column:
    """Tokens of 24 or more characters with a digit, a letter and enough entropy."""
    long = F.regexp_extract_all(text, F.lit(f"({K.SECRET})"), 1)
    return F.filter(long, lambda t: t.rlike("[0-9]") & t.rlike("[A-Za-z]") & (T.char_entropy(t) >= K.SECRET_ENTROPY))


def _normal(text: str) -> str:
    return unicodedata.normalize("NFKC", text.translate({ord(c): "." for c in "。｡︒﹒･‧"}))


def _luhn(digits: str) -> bool:
    if not 13 <= len(digits) <= 19:
        return False
    folded = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
    return sum(folded) % 10 == 0


def _entropy(token: str) -> float:
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values())


def _phone_like(v: str) -> bool:
    years = re.findall(r"\d+", v)
    dated = re.fullmatch(r"\d{4}-\d{2}-\d{2}", v) or all(len(y) == 4 and 1900 <= int(y) <= 2099 for y in years)
    return not dated and sum(c.isdigit() for c in v) >= 8


# kind, pattern, group of the value, accepted if, value under which a repeat is the same
_RULES = {
    "INVITE": ("INVITE", re.compile(K.INVITE, re.I), 0, None, None),
    "EMAIL": ("EMAIL", re.compile(K.EMAIL), 0, None, None),
    "MENTION": ("DISCORD_ID", re.compile(K.MENTION), 1, None, None),
    "URL": ("URL", re.compile(K.URL, re.I), 0, None, None),
    "CARD": ("CARD", re.compile(K.CARD), 0, lambda v: _luhn(re.sub(r"\D", "", v)), r"\D"),
    "PHONE": ("PHONE", re.compile(K.PHONE), 1, _phone_like, r"\D"),
    "IPV6": ("IP", re.compile(K.IPV6), 0, lambda v: ("::" in v or v.count(":") == 7) and re.search("[0-9A-Fa-f]", v), None),
    "IPV4": ("IP", re.compile(K.IPV4), 0, None, None),
    "HANDLE": ("HANDLE", re.compile(K.HANDLE), 1, None, None),
    "ID": ("DISCORD_ID", re.compile(K.SNOWFLAKE), 0, None, None),
    "SECRET": ("SECRET", re.compile(K.SECRET), 0, lambda v: _entropy(v) >= K.SECRET_ENTROPY and re.search(r"\d", v) and re.search(r"[^\W\d_]", v), None),
}
CORE = ("INVITE", "EMAIL", "MENTION", "URL", "CARD", "PHONE", "IPV6", "IPV4", "HANDLE", "ID", "SECRET")
EGRESS = ("INVITE", "EMAIL", "MENTION", "*", "CARD", "IPV6", "IPV4", "ID", "PHONE", "SECRET")


def redact_text(text: str | None, order: tuple[str, ...] = CORE) -> tuple[str, dict[str, int]]:
    """(text with numbered placeholders, counts by kind). At '*' links and handles are set aside and come back at the end.

    A value that repeats has one placeholder. With '*' a text in which nothing is found comes back as it was.
    """
    work, found, aside = _normal(text or ""), Counter(), []
    frame = "\0"  # frames the numbers of what is set aside; a text that has it gets a longer one
    while frame in work:
        frame += "\0"
    numbers: dict[str, dict[str, int]] = {}
    for name in order:
        if name == "*":
            for key in ("URL", "HANDLE"):
                pattern = _RULES[key][1]

                def put_aside(m):
                    aside.append(m[0])
                    return f"{frame}{len(aside) - 1}{frame}"

                work = pattern.sub(put_aside, work)
            continue
        kind, pattern, group, accepts, strip = _RULES[name]

        def replace(m, kind=kind, group=group, accepts=accepts, strip=strip):
            value = m[group]
            if accepts and not accepts(value):
                return m[0]
            found[kind] += 1
            seen = numbers.setdefault(kind, {})
            return f"[{kind}_{seen.setdefault(re.sub(strip, '', value) if strip else value, len(seen) + 1)}]"

        work = pattern.sub(replace, work)
    if aside:
        work = re.sub(f"{frame}(\\d+){frame}", lambda m: aside[int(m[1])], work)
    return (text or "" if "*" in order and not found else work), dict(found)


#: What every rule needs some of: an @, a run of digits, colons, a link, a long token, or a character that normalising may change.
MAY_HAVE = r"(?i)@|\d[\d\s().\-]{7,}\d|(?:\d{1,3}\.){3}\d|::|(?:[0-9a-f]{1,4}:){7}|https?://|discord|[a-z0-9_\-]{24}|[^\x00-\x7F\x{C0}-\x{131}]"


def redact(text: Column, order: tuple[str, ...] = CORE) -> Column:
    """struct<redacted, found> of redact_text(); sequential numbering is what keeps this in Python.

    Texts in which no rule can find anything don't go there: they come back as they are.
    """

    @F.pandas_udf(REDACTED)
    def run(texts: pd.Series) -> pd.DataFrame:
        out = [("", {}) if t is None else redact_text(t, order) for t in texts]
        return pd.DataFrame({"redacted": [r for r, _ in out], "found": [f for _, f in out]})

    text = F.coalesce(text, F.lit(""))
    asked = text.rlike(MAY_HAVE)
    done = run(F.when(asked, text))
    return F.struct(F.when(asked, done["redacted"]).otherwise(text).alias("redacted"), done["found"].alias("found"))


def has_pii(text: Column) -> Column:
    """True where the core redaction finds anything."""
    return F.size(redact(text)["found"]) > 0


def pseudonym(ident: Column, salt: bytes) -> Column:
    """'u_' and 16 hex digits of the HMAC-SHA256 under a salt."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else "u_" + hmac.new(salt, str(v).encode(), "sha256").hexdigest()[:16])

    return run(ident.cast("string"))


# ---------------------------------------------------------------- dashes

_D = "[–—]"


def fix_dashes(segment: Column) -> Column:
    """Spaced dashes become a comma, ASCII ranges 'A to B', what is left a comma by its place; table cells are for fix_table_row."""
    s = F.regexp_replace(segment, rf"(?U)\s+{_D}+\s+", ", ")
    s = F.regexp_replace(s, rf"([A-Za-z0-9]){_D}+([A-Za-z0-9])", "$1 to $2")
    s = F.regexp_replace(s, rf"(?:[ \t]+{_D}+[ \t]*|{_D}+[ \t]+)(?=\r?\z)", ",")
    s = F.regexp_replace(s, rf"\A[ \t]*{_D}+[ \t]+", "")
    s = F.regexp_replace(s, rf"[ \t]+{_D}+[ \t]*|{_D}+[ \t]+", ", ")
    return F.regexp_replace(s, rf"{_D}+", ",")


def fix_line(line: Column) -> Column:
    """A line of Markdown outside fences: its table cells, then its prose, without what stands in inline code."""
    line = fix_table_row(line)
    code = F.regexp_extract_all(line, F.lit("(`[^`]*`)"), 1)
    prose = F.transform(F.split(line, "`[^`]*`"), fix_dashes)
    return F.array_join(F.flatten(F.transform(prose, lambda p, i: F.array(p, F.coalesce(F.get(code, i), F.lit(""))))), "")


def rewrite_dashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lineno, line) with the dashes of prose rewritten; fenced lines stay as they are."""
    lines = lines_with_fences(docs, id_col, text_col)
    return lines.select(id_col, "lineno", F.when(F.col("fenced"), F.col("line")).otherwise(fix_line(F.col("line"))).alias("line"))


def fix_table_row(line: Column) -> Column:
    """In a pipe row a cell that is a dash says none, and one that opens with a dash opens with a hyphen."""
    row = line.rlike(r"^ {0,3}\|.*\|")
    out = F.regexp_replace(line, rf"(?U)(?<=\|)\s*{_D}+\s*(?=\|)", " none ")
    out = F.regexp_replace(out, rf"(?U)(?<=\|)\s*{_D}+\s*?(?=\r?\z)", " none")
    out = F.regexp_replace(out, rf"(?U)(?<=\|)(\s*){_D}+(?=[ \t]\S)", "$1-")
    return F.when(row, out).otherwise(line)


def lines_with_fences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lineno, line, fenced): a fence line and those up to the next one are code; the state is a running count."""
    lines = docs.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("lineno", "line"))
    mark = F.col("line").rlike(r"^\s*(```|~~~)").cast("int")
    upto = F.sum(mark).over(Window.partitionBy(id_col).orderBy("lineno"))
    return lines.withColumn("fenced", (upto % 2 == 1) | (mark == 1))


# ---------------------------------------------------------------- duplicated prose, paths, denylist


def shingle_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct (id, shingle), a shingle as its 64-bit hash.

    A row's shingles are made distinct where it lies; only rows that repeat an id are compared with each other.
    """
    words = docs.select(id_col, T.prose_words(F.col(text_col)).alias("words"))
    # explode_outer: explode would add a filter on the array, and so compute the words again for each shingle.
    # A shingle is known by 64 bits of its words from here on: an eighth of what its text would shuffle.
    hashes = F.array_distinct(F.transform(T.shingles(F.col("words")), lambda s: F.xxhash64(s)))
    rows = words.select(id_col, F.explode_outer(hashes).alias("shingle")).filter("shingle IS NOT NULL")
    twice = kept(docs.groupBy(F.col(id_col).alias("__id")).agg(F.count("*").alias("__n")).filter("__n > 1").select("__id"), "repeated-ids")
    if twice.isEmpty():
        return rows
    same = F.col(id_col).eqNullSafe(F.col("__id"))
    return rows.join(twice, same, "left_anti").unionByName(rows.join(twice, same, "left_semi").distinct())


def duplicate_share(docs: DataFrame, refs: DataFrame, id_col: str = "doc_id", ref_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, n_dup, dup_pct): a document's distinct shingles that some reference has too."""
    own = shingle_rows(docs, id_col, text_col)
    # a table, so that Spark knows its size, and few references are broadcast
    known = kept(shingle_rows(refs, ref_col, text_col).select("shingle").distinct(), "known-shingles").withColumn("dup", F.lit(1))
    joined = own.join(known, "shingle", "left")
    out = joined.groupBy(id_col).agg(F.count("*").alias("n_shingles"), F.count("dup").alias("n_dup"))
    return out.withColumn("dup_pct", F.round(100 * F.col("n_dup") / F.greatest("n_shingles", F.lit(1)), 2))


def top_offenders(docs: DataFrame, refs: DataFrame, id_col: str = "doc_id", ref_col: str = "item_id", text_col: str = "text", most: int = 5) -> DataFrame:
    """(id, ref, n): the `most` references that share the most distinct shingles with a document, ties by the greater id.

    A report of the top few by definition; what is counted for it covers all shingles of all references.
    """
    own, known = shingle_rows(docs, id_col, text_col), kept(shingle_rows(refs, ref_col, text_col), "known-shingles")
    shared = own.join(known, "shingle").groupBy(id_col, ref_col).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("n"), F.desc(ref_col)))
    return shared.withColumn("__rank", rank).filter(F.col("__rank") <= most).drop("__rank")


def shared_first_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """(a, b, n): pairs of documents that own many shingles together; of each shingle the two least owners count.

    One shuffle by shingle, before which each task keeps its two least owners only: a shingle that all have makes no large group.
    """
    rows = shingle_rows(docs, id_col, text_col).filter(F.col(id_col).isNotNull())
    first = F.row_number().over(Window.partitionBy("shingle").orderBy(id_col))
    two = rows.withColumn("__rank", first).filter("__rank <= 2").groupBy("shingle").agg(F.min(id_col).alias("a"), F.max(id_col).alias("b"), F.count("*").alias("__n"))
    return two.filter("__n = 2").groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def covered(path: Column, prefixes: list[str]) -> Column:
    """The path is one of the prefixes or lies under one."""
    return F.coalesce(*[F.when((path == p.rstrip("/")) | path.startswith(p.rstrip("/") + "/"), True) for p in prefixes], F.lit(False))


def path_shape(path: Column) -> Column:
    """The first run-output shape that a path has, or null; example and template names are exempt."""
    shape = F.coalesce(*[F.when(path.rlike(pattern), name) for name, pattern in K.RUN_SHAPES])
    return F.when(~path.rlike(K.SHAPE_EXEMPT), shape)


def severity(kind: Column, domain: Column) -> Column:
    """secret blocks; linkage blocks but in history, where it is a debt; derived warns."""
    return F.when(kind == "secret", "BLOCK").when((kind == "linkage") & (domain == "history"), "DEBT").when(kind == "linkage", "BLOCK").otherwise("WARN")


def denied(text: Column, tokens: list[str]) -> Column:
    """The denylist tokens that a text has: words for alphabetic ones, substrings for those with a digit or without letters.

    One alternation decides first; only texts it admits are held against each token.
    """
    lower = F.lower(F.coalesce(text, F.lit("")))
    rule = {t: rf"(?<![a-z0-9_]){re.escape(t.lower())}(?![a-z0-9_])" if re.fullmatch(r"[^\d]*[A-Za-z][^\d]*", t) else re.escape(t.lower()) for t in tokens}
    any_ = lower.rlike("|".join(re.escape(t.lower()) for t in tokens))
    return F.when(any_, F.array_compact(F.array(*[F.when(lower.rlike(p), t) for t, p in rule.items()]))).otherwise(F.array().cast("array<string>"))
