"""Structural scan of texts for personal data: mailboxes, addresses, phone numbers, postal codes and home paths.

All rules are built-in functions: values are extracted as arrays, exploded to findings and held against allow rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shapes, and what is no person's data.
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9][A-Za-z0-9.\-]*\.[A-Za-z]{2,}\b"
PHONE = r"(?<![\w.\-])(?:\+?1[\s.\-])?\(?([2-9]\d{2})\)?[\s.\-]([2-9]\d{2})[\s.\-](\d{4})(?![\w.\-])"
PLAIN_PHONE = r"(?<![\w.\-])(?:1-)?[2-9]\d{2}-[2-9]\d{2}-\d{4}(?![\w.\-])"
ZIP = (
    r"(?i)(?:\bzip\s*code\b|\bzipcode\b|\bpostal\s*code\b|邮编|\bship(?:ping)?\s+to\b|\bdeliver\s+to\b|\bzip\b(?!\s*(?:archive|file|files|format|compress|compressed|compression"
    r"|extract|extraction|bomb|entry|entries|member|members|64|utility|tool|stream|reader|writer)))[^\n]{0,24}?\b([0-9]{5})\b"
)
USER_PATH = r"(?:[A-Za-z]:\\{1,4}Users\\{1,4}|/(?:home|Users)/)([A-Za-z0-9][\w.\-]{0,31})"
HOME = r"(?:~|\$HOME|\$env:USERPROFILE|\$env:HOME|%USERPROFILE%)"
PERSONAL_DOMAINS = "gmail.com googlemail.com outlook.com hotmail.com live.com msn.com yahoo.com ymail.com aol.com icloud.com me.com mac.com proton.me protonmail.com pm.me tutanota.com zoho.com gmx.com mail.com qq.com foxmail.com 163.com 126.com sina.com yeah.net".split()
PLACEHOLDERS = "x y z a b u me you user user1 user2 test foo bar someone example your-email youremail".split()
ALLOWED_DOMAINS = "example.com example.org example.net example.edu acme.com acme.io acme.test test.com localhost domain.com users.noreply.github.com noreply.github.com github.com".split()
ALLOWED_SUFFIXES = ".test .invalid .example .local .internal .localdomain .example.com .example.org .example.net".split()
NO_DOMAIN = r"(?i)^(pytest|mark|fixture|param|parametrize|patch|mock|staticmethod|classmethod|property|dataclass|app|router|task)\b"
ALLOWED_ZIPS = "10001 00000 12345 90210".split()
GENERIC_USERS = (
    "public default defaultuser administrator admin user users shared guest root runner runneradmin vscode distiller vagrant ubuntu ec2-user circleci travis jenkins you youruser username "
    "name someone example test me home app docker node foo bar baz alice bob yourname your-name"
).split()
DIMENSIONS = (
    "kernel layer layers dim dims dimension shape size sizes conv hidden channel channels stride padding batch seq embed embedding filter filters units neurons heads width height "
    "resolution mlp ffn vocab window patch grid tile block blocks stage stages"
).split()
CONTEXT = 40
LONG_FRAGMENT, PATH_FRAGMENT = 8, 5


def email_ok(address: Column, allow: list[str]) -> Column:
    """Listed, a decorator, or in a domain that is kept for examples and machines."""
    domain = F.lower(F.substring_index(address, "@", -1))
    reserved = domain.isin(ALLOWED_DOMAINS) | domain.rlike("^example[-.]") | F.exists(F.array(*map(F.lit, ALLOWED_SUFFIXES)), lambda s: F.endswith(domain, s))
    return F.lower(address).isin(allow) | domain.rlike(NO_DOMAIN) | reserved


def specific(entry: str) -> bool:
    """Whether an allow entry is long enough, or enough of a path, to spare what only contains it."""
    return len(entry) >= LONG_FRAGMENT or (len(entry) >= PATH_FRAGMENT and any(c in entry for c in "./\\"))


def allowed_fragment(value: Column, allow: list[str]) -> Column:
    """Equal to an allow entry, or containing one that is specific."""
    low = F.lower(value)
    found = low.isin(allow)
    for entry in filter(specific, allow):
        found = found | F.contains(low, F.lit(entry))
    return found


def without_shapes(text: Column) -> Column:
    """A text without the hyphened number triples that stand near a word for dimensions, such as 512-256-1024."""
    before = "|".join(rf"\b{w}\b.{{0,{CONTEXT - len(w)}}}" for w in DIMENSIONS)
    after = "|".join(rf".{{0,{CONTEXT - len(w)}}}\b{w}\b" for w in DIMENSIONS)
    bare = F.regexp_replace(text, rf"(?is)(?:(?<=(?:{before})){PLAIN_PHONE}|{PLAIN_PHONE}(?=(?:{after})))", " ")
    return F.when(text.rlike(PLAIN_PHONE), bare).otherwise(text)


def scan(docs: DataFrame, id_col: str, text_col: str, allow: list[str] | None = None, private_dirs: list[str] | None = None, strict: bool = True) -> DataFrame:
    """(id, label, value): distinct findings of each text; null and empty texts have none.

    `strict` (content that is written now) also reports addresses outside the namespaces for examples. `private_dirs` are
    names of dot folders that are nobody's business below a home folder.
    """
    allow = [a.lower() for a in allow or []]
    text = F.coalesce(F.col(text_col), F.lit(""))
    local, domain = F.lower(F.substring_index("v", "@", 1)), F.lower(F.substring_index("v", "@", -1))
    listed = F.lower("v").isin(allow)
    person = domain.isin(PERSONAL_DOMAINS) & ~local.isin(PLACEHOLDERS)

    bare = without_shapes(text)
    parts = [F.regexp_extract_all(bare, F.lit(PHONE), i) for i in (1, 2, 3)]
    number = F.zip_with(F.zip_with(parts[0], parts[1], lambda a, b: F.concat_ws("-", a, b)), parts[2], lambda a, b: F.concat_ws("-", a, b))
    private = rf"(?i){HOME}[\\/](\.(?:{'|'.join(private_dirs or [])})\b[\w./\\-]*)"
    # Texts that can't have a value of a kind are told by a plain test before anything is extracted. One scan for all kinds.
    kinds = [
        ("EMAIL", F.contains(text, F.lit("@")), F.regexp_extract_all(text, F.lit(EMAIL), 0)),
        ("PHONE", text.rlike(r"[2-9]\d{2}\)?[\s.\-][2-9]\d{2}[\s.\-]\d{4}"), number),
        ("ZIP", text.rlike(r"(?i)(?:zip|postal|邮编|ship|deliver)[\s\S]*\d{5}"), F.regexp_extract_all(text, F.lit(ZIP), 1)),
        ("USER-PATH", text.rlike(r"\\Users\\|/home/|/Users/"), F.regexp_extract_all(text, F.lit(USER_PATH), 0)),
    ]
    if private_dirs:
        kinds.append(("PRIVATE-PATH", text.rlike(HOME), F.regexp_extract_all(text, F.lit(private), 0)))
    none = F.array().cast("array<string>")
    each = [F.transform(F.when(able, values).otherwise(none), _labelled(kind)) for kind, able, values in kinds]
    found = docs.select(id_col, F.explode(F.concat(*each)).alias("f")).select(id_col, "f.kind", "f.v").distinct()
    v = F.col("v")
    email = F.when(person, "PERSONAL-MAILBOX")
    if strict:
        email = email.when(~email_ok(v, allow), "EMAIL")
    kept = {
        "EMAIL": F.when(~listed, email),
        "PHONE": F.when(~v.rlike("^(555-|...-555-)") & ~listed, "PHONE"),
        "ZIP": F.when(~v.isin(ALLOWED_ZIPS) & ~v.isin(allow), "ZIP"),
        "USER-PATH": F.when(~F.lower(F.regexp_extract("v", USER_PATH, 1)).isin(GENERIC_USERS) & ~allowed_fragment(v, allow), "USER-PATH"),
        "PRIVATE-PATH": F.when(~allowed_fragment(F.regexp_extract("v", private, 1), allow), "PRIVATE-PATH"),
    }
    label = F.coalesce(*[F.when(F.col("kind") == kind, rule) for kind, rule in kept.items()])
    return found.select(id_col, label.alias("label"), v.alias("value")).filter("label IS NOT NULL")


def _labelled(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("v"))


def first_findings(findings: DataFrame, where: str = "where", pos: str = "pos") -> DataFrame:
    """(label, value, severity, where): each finding once, at its first place; values are equal without regard to case."""
    rows = findings.groupBy("label", F.lower("value").alias("key"), "severity")
    first = rows.agg(F.min_by(F.struct("value", F.col(where).alias("where")), F.struct(pos, where)).alias("f"))
    return first.select("label", F.col("f.value").alias("value"), "severity", F.col("f.where").alias("where"))


def receipt(grants: DataFrame, findings: DataFrame) -> DataFrame:
    """One row (declared, used, never_fired): exemptions, by token, and those that a finding needed."""
    used = findings.select(F.lower("value").alias("token")).distinct().withColumn("hit", F.lit(1))
    marked = grants.select(F.lower("token").alias("token")).join(used, "token", "left")
    return marked.agg(F.count("*").alias("declared"), F.count("hit").alias("used")).withColumn("never_fired", F.col("declared") - F.col("used"))


# What companions of a repository are called after it.
SUFFIXES = ["-config", "-data", "-private", "-secrets"]
MAP_DAYS = 30


def derivation_witness(names: DataFrame, public: DataFrame, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """names (owner, name) with witness: the public name of the same owner from which a name follows by a usual suffix, or null."""
    stems = F.array_compact(F.array(*[F.when(F.endswith("name", F.lit(s)), F.expr(f"left(name, length(name) - {len(s)})")) for s in suffixes]))
    asked = names.select("owner", "name", F.posexplode_outer(stems).alias("i", "stem"))
    met = asked.join(public.select("owner", F.col("name").alias("stem")).distinct().withColumn("known", F.lit(True)), ["owner", "stem"], "left")
    return met.groupBy("owner", "name").agg(F.min_by(F.when(F.col("known"), F.col("stem")), F.when(F.col("known"), F.col("i"))).alias("witness"))


def cross_repo_tokens(repos: DataFrame, self_name: str | None, map_age_days: float | None) -> DataFrame:
    """(token, kind, owner, witness): names of private repositories that no text should give away, one row a name.

    repos: (owner, name, private), a map of `map_age_days`; without an age there is no map and no token. A name counts if it is
    distinctive: five characters or more, and a companion's suffix or at least two marks (- or _). The own repository and
    its companions don't count. A name is `derived` if its owner has the public repository that it follows from, unless the map
    is older than MAP_DAYS; else it is `linkage`. Of owners with one name, one that makes it linkage goes first, then
    the least: the severer reading counts.
    """
    if map_age_days is None:
        return repos.limit(0).select(F.col("name").alias("token"), F.lit("").alias("kind"), "owner", F.lit("").alias("witness"))
    own = [self_name, *[self_name + s for s in SUFFIXES]] if self_name else []
    marks = F.length("name") - F.length(F.regexp_replace("name", "[-_]", ""))
    ends = F.lit(False)
    for s in SUFFIXES:
        ends = ends | F.endswith("name", F.lit(s))
    names = repos.filter(F.col("private") & (F.length("name") >= 5) & (ends | (marks >= 2)) & ~F.col("name").isin(own)).select("owner", "name").distinct()
    found = derivation_witness(names, repos.filter(~F.col("private")))
    witness = F.col("witness") if map_age_days <= MAP_DAYS else F.lit(None).cast("string")
    best = found.groupBy("name").agg(F.min(F.struct(witness.isNotNull().alias("derived"), "owner", witness.alias("witness"))).alias("b"))
    return best.select(F.col("name").alias("token"), F.when(F.col("b.derived"), "derived").otherwise("linkage").alias("kind"), "b.owner", "b.witness")


def is_template(path: Column) -> Column:
    """Files that restate the rule they are made from."""
    name = F.lower(F.substring_index(path, "/", -1))
    return name.rlike(r"template|fixture|_example|\.example\.md$")


def manifest_findings(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(kind, path) of a tree (path) against its manifest (path, kind 'data' or 'sealed').

    DATA-TRACKED: a file that is or lies under a declared path. NO-SCHEMA: a declared file without an example beside it
    (x.jsonl.example or x.example.jsonl).
    """
    prefixes = manifest.select(F.rtrim(F.col("path"), F.lit("/")).alias("prefix")).distinct()
    parts = F.split("path", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    tracked = files.select("path", F.explode(heads).alias("prefix")).join(prefixes, "prefix", "left_semi").select(F.lit("DATA-TRACKED").alias("kind"), "path").distinct()
    owed = manifest.filter((F.col("kind") == "data") & ~F.endswith("path", F.lit("/"))).select("path")
    inner = F.regexp_replace("path", r"^(.*[^/])(\.[^./]+)$", "$1.example$2")
    forms = owed.select("path", F.explode(F.array(F.concat("path", F.lit(".example")), F.when(inner != F.col("path"), inner).otherwise(F.concat("path", F.lit(".example"))))).alias("form"))
    met = forms.join(files.select(F.col("path").alias("form")), "form", "left_semi").select("path").distinct()
    return tracked.unionByName(owed.join(met, "path", "left_anti").select(F.lit("NO-SCHEMA").alias("kind"), F.concat("path", F.lit(".example")).alias("path")))


def fixture_differences(made: DataFrame, found: DataFrame) -> DataFrame:
    """(path, state) of files (path, content) that are missing, extra or differ, line ends apart."""
    print_ = lambda c: F.sha2(F.regexp_replace(c, "\r\n", "\n"), 256)
    both = made.select("path", print_(F.col("content")).alias("a")).join(found.select("path", print_(F.col("content")).alias("b")), "path", "full")
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "differs")
    return both.select("path", state.alias("state")).filter("state IS NOT NULL")


def unaudited(manifests: DataFrame) -> DataFrame:
    """Manifests (name, data array, audited) that declare no data and don't say why."""
    return manifests.filter((F.coalesce(F.size("data"), F.lit(0)) <= 0) & (F.trim(F.coalesce("audited", F.lit(""))) == ""))
