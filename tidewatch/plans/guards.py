"""Text guards over documents, conversations and addresses of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import fixed as K
from tidewatch.functions import text as T
from tidewatch.operators import guards
from tidewatch.plans.catalog import query, table
from tidewatch.plans.redaction_sql import redaction


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query(r"""
SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS emails, len(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b')) AS ipv4,
  len(regexp_extract_all(text, '\bhttps?://\S+')) AS urls FROM documents
""")
def q_pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses, IPv4 numbers and links of each document, counted natively."""
    n = guards.pii_counts(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", *[n[c].cast("long").alias(c) for c in ("emails", "ipv4", "urls")])


# Each character that is no digit is followed by a mark, so that a match and the next can both have one before and after them: the twin has no lookaround.
@query(r"""
SELECT doc_id, digits FROM (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(regexp_replace(text, '(\D)', '\1' || chr(1), 'g'), '(?:^|\D)((?:\d(?:[ -]\x01)?){13,19})(?:\D|$)', 1)), '\D', '', 'g') AS digits FROM documents)
WHERE list_sum(list_transform(range(length(digits)), lambda i: (digits[length(digits) - i]::INT * (1 + i % 2)) // 10 + (digits[length(digits) - i]::INT * (1 + i % 2)) % 10)) % 10 = 0
""")
def q_luhn_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card numbers that pass the Luhn check."""
    return docs(spark, sf_dir).select("doc_id", F.explode(guards.luhn_cards(F.col("text"))).alias("digits"))


_SECRETS = r"SELECT doc_id, t AS token FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Za-z0-9_\-]{24,}\b')) AS t FROM documents) WHERE regexp_matches(t, '[0-9]') AND regexp_matches(t, '[A-Za-z]')"


@query(f"""
SELECT doc_id, token, round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT doc_id, token, c, count(*) / length(token) AS p FROM (SELECT *, unnest(string_split(token, '')) AS c FROM (SELECT DISTINCT * FROM ({_SECRETS}))) GROUP BY doc_id, token, c)
GROUP BY doc_id, token HAVING round(-sum(p * log2(p)), 9) >= 3.5
""")
def q_secret_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tokens that look like secrets, with their entropy."""
    found = docs(spark, sf_dir).select("doc_id", F.explode(guards.secret_tokens(F.col("text"))).alias("token")).distinct()
    return found.select("doc_id", "token", F.round(T.char_entropy(F.col("token")), 6).alias("entropy"))


_TURNS = "SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || conv_id || '.' || turn, text FROM conversations"


@query(f"SELECT id, redacted, found FROM ({redaction(_TURNS, guards.EGRESS, guards.MAY_HAVE)})")
def q_redact_egress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and turns of conversations with personal data replaced in place."""
    d = docs(spark, sf_dir).select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("."), "turn").alias("id"), "text")
    r = d.unionByName(c).withColumn("r", guards.redact(F.col("text"), guards.EGRESS))
    return r.select("id", "r.redacted", F.to_json("r.found").alias("found"))


@query(f"SELECT id AS doc_id, total > 0 AS has_pii, redacted FROM ({redaction('SELECT doc_id AS id, text FROM documents', guards.CORE, guards.MAY_HAVE)})")
def q_redact_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after the stricter redaction that takes links and handles too."""
    r = docs(spark, sf_dir).withColumn("r", guards.redact(F.col("text"), guards.CORE))
    return r.select("doc_id", (F.size("r.found") > 0).alias("has_pii"), "r.redacted")


_SALT = b"fixed for this query"
_INNER, _OUTER = (bytes(b ^ pad for b in _SALT.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))


@query(f"SELECT DISTINCT source, 'u_' || left(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(source)))), 16) AS pseudonym FROM documents")
def q_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Salted pseudonyms of the sources; the twin spells the HMAC out."""
    s = table(spark, sf_dir, "documents").select("source").distinct()
    return s.select("source", guards.pseudonym(F.col("source"), _SALT).alias("pseudonym"))


_PROSE = r"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '```.*?```', ' ', 'gs'), '^\s*\|.*\|\s*$', ' ', 'gm'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[`*_#>]', ' ', 'g')), '\s+'), lambda w: regexp_matches(w, '\p{L}'))"


def _shingles(id: str, table: str) -> str:
    return f"SELECT DISTINCT {id}, s FROM (SELECT {id}, unnest(list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i : i + 7], ' '))) AS s FROM (SELECT {id}, {_PROSE} AS w FROM {table}))"


@query("WITH d AS (" + _shingles(id="doc_id", table="documents") + "), b AS (SELECT DISTINCT s FROM (" + _shingles(id="item_id", table="benchmark") + ")) SELECT doc_id, count(*) AS n_shingles, count(b.s) AS n_dup, round(100 * count(b.s) / count(*), 2) AS dup_pct FROM d LEFT JOIN b USING (s) GROUP BY ALL")
def q_shingle_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each document's eight-word shingles that the benchmark has too."""
    return guards.duplicate_share(docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query("WITH d AS (" + _shingles(id="doc_id", table="documents") + "), o AS (SELECT s, list_sort(list(doc_id))[1] AS a, list_sort(list(doc_id))[2] AS b FROM d GROUP BY s HAVING count(*) > 1) SELECT a, b, count(*) AS n FROM o GROUP BY ALL HAVING count(*) >= 12")
def q_cross_doc_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that are the first two owners of twelve or more shingles."""
    return guards.shared_first_owners(docs(spark, sf_dir))


@query("WITH d AS (" + _shingles(id="doc_id", table="documents") + "), b AS (" + _shingles(id="item_id", table="benchmark") + "), n AS (SELECT doc_id, item_id, count(*) AS n FROM d JOIN b USING (s) GROUP BY ALL) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, item_id DESC) <= 5")
def q_top_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five benchmark items that share the most shingles with each document."""
    return guards.top_offenders(docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query("""
SELECT d.doc_id, kind, domain, CASE WHEN kind = 'secret' THEN 'BLOCK' WHEN kind = 'linkage' AND domain = 'history' THEN 'DEBT' WHEN kind = 'linkage' THEN 'BLOCK' ELSE 'WARN' END AS severity FROM
(SELECT d.doc_id, CASE d.doc_id % 3 WHEN 0 THEN 'secret' WHEN 1 THEN 'linkage' ELSE 'derived' END AS kind, CASE WHEN l.doc_id IS NULL THEN 'history' ELSE 'tree' END AS domain FROM documents d LEFT JOIN labels l USING (doc_id)) d
""")
def q_severity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity by kind of token and where it stands."""
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "left")
    kind = F.when(F.col("doc_id") % 3 == 0, "secret").when(F.col("doc_id") % 3 == 1, "linkage").otherwise("derived")
    d = d.select("doc_id", kind.alias("kind"), F.when(F.col("l").isNull(), "history").otherwise("tree").alias("domain"))
    return d.withColumn("severity", guards.severity(F.col("kind"), F.col("domain")))


_DENY = ["mit license", "version 3", "idiot", "cc by-nc 4.0"]


@query(r"""
SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(x, '(^|[^a-z0-9_])mit license([^a-z0-9_]|$)') THEN 'mit license' END, CASE WHEN contains(x, 'version 3') THEN 'version 3' END,
CASE WHEN regexp_matches(x, '(^|[^a-z0-9_])idiot([^a-z0-9_]|$)') THEN 'idiot' END, CASE WHEN contains(x, 'cc by-nc 4.0') THEN 'cc by-nc 4.0' END], lambda t: t IS NOT NULL), ',') AS denied
FROM (SELECT doc_id, lower(text) AS x FROM documents) WHERE denied <> ''
""")
def q_denylist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with denylist tokens: one prefilter, then each token by its own rule."""
    d = docs(spark, sf_dir).withColumn("denied", F.array_join(guards.denied(F.col("text"), _DENY), ","))
    return d.filter("denied <> ''").select("doc_id", "denied")


_PATH = "CASE page_id % 8 WHEN 0 THEN 'metrics/' || page_id || '.jsonl' WHEN 1 THEN 'a/runs/' || page_id WHEN 2 THEN 'reports/x-2024-01-02.md' WHEN 3 THEN 'state/' || page_id || '.ndjson' WHEN 4 THEN 'b/ledger.jsonl' WHEN 5 THEN 'dedup-state.json' WHEN 6 THEN 'data/' || page_id || '.sqlite' ELSE 'runs/x.example.json' END"


@query(f"""
SELECT page_id, path, coalesce(CASE WHEN regexp_matches(path, '\\.(example|sample|tmpl|template)(\\.|$)') THEN NULL WHEN path LIKE 'metrics/%' THEN 'metrics-ledger' WHEN path LIKE '%runs/%' THEN 'runs-dir' WHEN path LIKE 'reports/%' THEN 'dated-output'
 WHEN path LIKE 'state/%' THEN 'output-ledger' WHEN path LIKE '%ledger.jsonl' THEN 'ledger-name' WHEN path LIKE '%dedup-state.json' THEN 'state-name' WHEN path LIKE '%.sqlite' THEN 'database' END, '') AS shape,
 path = 'data' OR path LIKE 'data/%' OR path LIKE 'a/runs/%' AS declared FROM (SELECT page_id, {_PATH} AS path FROM pages)
""")
def q_path_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-output shapes of paths, and whether a manifest covers them."""
    p = table(spark, sf_dir, "pages").select("page_id", F.expr(_PATH).alias("path"))
    return p.select("page_id", "path", F.coalesce(guards.path_shape(F.col("path")), F.lit("")).alias("shape"), guards.covered(F.col("path"), ["data", "a/runs/"]).alias("declared"))


@query("""
SELECT doc_id, lineno, (f % 2 = 1) OR m AS fenced FROM (SELECT doc_id, lineno, line LIKE 'The %' AS m, sum((line LIKE 'The %')::INT) OVER (PARTITION BY doc_id ORDER BY lineno) AS f
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS lineno FROM documents))
""")
def q_fence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of each document are fenced; here a line that opens with 'The ' stands for a fence mark, for the table has none."""
    marked = docs(spark, sf_dir).withColumn("text", F.regexp_replace("text", "(?m)^The ", "```"))
    out = guards.lines_with_fences(marked)
    return out.select("doc_id", F.col("lineno").cast("long").alias("lineno"), "fenced")


_DASH, _BLANK = "[–—]+", r"[\s\x0B\x{85}\p{Z}]"


def _undashed(x: str) -> str:
    """SQL of prose without its dashes, rule by rule."""
    ends = rf"(?:[ \t]+{_DASH}[ \t]*|{_DASH}[ \t]+)"
    rules = [
        (rf"{_BLANK}+{_DASH}{_BLANK}+", ", "), (rf"([A-Za-z0-9]){_DASH}([A-Za-z0-9])", r"\1 to \2"), (rf"{ends}(\r?)\z", r",\1"),
        (rf"\A[ \t]*{_DASH}[ \t]+", ""), (rf"[ \t]+{_DASH}[ \t]*|{_DASH}[ \t]+", ", "), (_DASH, ","),
    ]
    for pattern, by in rules:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


def _cells(x: str) -> str:
    """SQL of a table row without dashes; its bars are doubled meanwhile, so that two cells don't share one."""
    rules = [(rf"\|{_BLANK}*{_DASH}{_BLANK}*\|", "| none |"), (rf"\|{_BLANK}*{_DASH}{_BLANK}*?(\r?)\z", r"| none\1"), (rf"\|({_BLANK}*){_DASH}([ \t][^\s\x0B\x{{85}}\p{{Z}}])", r"|\1-\2")]
    x = f"replace({x}, '|', '||')"
    for pattern, by in rules:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return f"replace({x}, '||', '|')"


def _dashes_sql(text: str) -> str:
    return rf"""
WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS lineno FROM (SELECT doc_id, {text} AS t FROM documents)),
f AS (SELECT *, regexp_matches(line, '^\s*(```|~~~)') AS m FROM l), g AS (SELECT *, m OR sum(m::INT) OVER (PARTITION BY doc_id ORDER BY lineno) % 2 = 1 AS fenced FROM f),
r AS (SELECT doc_id, lineno, fenced, line, CASE WHEN regexp_matches(line, '^ {{0,3}}\|.*\|') THEN {_cells('line')} ELSE line END AS row FROM g),
p AS (SELECT *, regexp_split_to_array(row, '`[^`]*`') AS prose, regexp_extract_all(row, '`[^`]*`') AS code FROM r)
SELECT doc_id, lineno::INT AS lineno, CASE WHEN fenced THEN line ELSE array_to_string(list_transform(range(1, len(prose) + 1), lambda i: {_undashed('prose[i]')} || coalesce(code[i], '')), '') END AS line FROM p
"""


@query(_dashes_sql("replace(text, ',', '—')"))
def q_dash_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashes of prose and table lines rewritten; commas of the text stand for dashes, for the table has none."""
    return guards.rewrite_dashes(docs(spark, sf_dir).select("doc_id", F.translate("text", ",", "—").alias("text")))


@query(_dashes_sql("regexp_replace(replace(replace(replace(replace(text, '. ', chr(10)), ',', '—'), ' and ', ' — '), ' the ', '`'), '(?m)^([A-M][^\\n]*) (is|of|to|in) ', '| — |\\1| – |— \\2|', 'g')"))
def q_dash_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashes rewritten by where they stand: one sentence a line, 'and' a spaced dash, 'the' a mark of inline code, and some lines rows of a table."""
    text = F.expr(r"""replace(replace(replace(replace(text, '. ', '\n'), ',', '—'), ' and ', ' — '), ' the ', '`')""")
    rows = F.regexp_replace(text, r"(?m)^([A-M][^\n]*) (is|of|to|in) ", "| — |$1| – |— $2|")
    return guards.rewrite_dashes(docs(spark, sf_dir).select("doc_id", rows.alias("text")))


@query(r"SELECT page_id, CASE WHEN regexp_full_match(trim(url), 'https?://[^\s<>]+') THEN trim(url) ELSE '' END AS clean FROM pages")
def q_url_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that can be linked to."""
    return table(spark, sf_dir, "pages").select("page_id", T.clean_url(F.col("url")).alias("clean"))


assert K.SHINGLE_WORDS == 8  # the SQL twins spell it out
