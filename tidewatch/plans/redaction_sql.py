"""The numbered redaction as SQL, rule by rule: a twin that shares no code and no engine with the operator.

A text is split at the matches of a rule; a match that is accepted becomes a placeholder with the place of its value
among the distinct values of its kind so far. The twin's patterns have no lookaround: where a rule looks at its
neighbours, a mark follows every character that may be one, so that a match can take the mark before it and the
character after it and still leave both to its neighbours.
"""

from __future__ import annotations

from tidewatch.functions import fixed as K

MARK, END = "\x01", "\x03"
_WORD, _SPACE, _H = r"\p{L}\p{N}_", r"\s\x0B\x1C-\x1F\x{85}\p{Z}", "[0-9A-Fa-f]"
_DIGITS = r"regexp_replace(v, '\D', '', 'g')"
_LUHN = f"length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length({_DIGITS})), lambda i: (({_DIGITS})[length({_DIGITS}) - i]::INT * (1 + i % 2)) // 10 + (({_DIGITS})[length({_DIGITS}) - i]::INT * (1 + i % 2)) % 10)) % 10 = 0"
_CALLABLE = rf"length({_DIGITS}) >= 8 AND NOT regexp_full_match(v, '\d{{4}}-\d{{2}}-\d{{2}}') AND NOT regexp_full_match(v, '\D*(?:(?:19|20)\d\d\D+)*(?:19|20)\d\d\D*')"
_MIXED = f"regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND round(list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: -len(list_filter(string_split(v, ''), lambda d: d = c)) / length(v) * log2(len(list_filter(string_split(v, ''), lambda d: d = c)) / length(v)))), 9) >= {K.SECRET_ENTROPY}"
_PATH6 = rf"(?:(?:{_H}{{1,4}}:){{7}}{_H}{{1,4}}|(?:{_H}{{1,4}}:)*{_H}{{0,4}}::(?:{_H}{{1,4}}:)*{_H}{{0,4}})"
_AS_IS = "v"

# kind, characters that may not stand beside a match ('' where the pattern says so itself), pattern, accepted if, what makes two values one
_RULES = {
    "INVITE": ("INVITE", "", rf"(?i:\b(?:https?://)?(?:discord\.gg|discord(?:app)?\.com/invite)/[^{_SPACE}]+)", "true", _AS_IS),
    "EMAIL": ("EMAIL", "", K.EMAIL, "true", _AS_IS),
    "MENTION": ("DISCORD_ID", "", r"<@!?\d{15,21}>", "true", _DIGITS),
    "URL": ("URL", "", rf"(?i:\bhttps?://[^{_SPACE}]+)", "true", _AS_IS),
    "CARD": ("CARD", r"\d", r"(?:\d(?:[ \-]\x01)?){13,19}", _LUHN, _DIGITS),
    "PHONE": ("PHONE", _WORD, rf"(?:\+\x01)?\d(?:\d|[{_SPACE}().\-]\x01){{7,}}\d", _CALLABLE, _DIGITS),
    "IPV6": ("IP", _WORD + ":.", _PATH6, f"(contains(v, '::') OR length(v) - length(replace(v, ':', '')) = 7) AND regexp_matches(v, '{_H}')", _AS_IS),
    "IPV4": ("IP", "", K.IPV4, "true", _AS_IS),
    "HANDLE": ("HANDLE", _WORD + "/", r"@\x01[A-Za-z0-9_]{2,32}", "true", "substr(v, 2)"),
    "ID": ("DISCORD_ID", "", K.SNOWFLAKE, "true", _AS_IS),
    "SECRET": ("SECRET", "", K.SECRET, _MIXED, _AS_IS),
}
_KINDS = ("INVITE", "EMAIL", "DISCORD_ID", "URL", "CARD", "PHONE", "IP", "HANDLE", "SECRET", "aside")


def _step(before: str, after: str, name: str, aside: bool) -> str:
    """CTEs that take the texts of one rule further: matches, their values, and the text with placeholders."""
    kind, beside, core, accepts, same = _RULES[name]
    seen = "seen_aside" if aside else f"seen_{kind}"
    marked, pattern = "t", f"()({core})()"
    if beside:
        marked = rf"'{MARK}' || regexp_replace(t, '([^{beside}])', '\1{MARK}', 'g') || '{END}'"
        pattern = rf"(\x01)({core})([^{beside.rstrip('/')}\x01])"  # a slash is barred before a match only
    value = f"replace(regexp_extract(x, '{pattern}', 2), '{MARK}', '')"
    put = "chr(4) || (nth) || chr(5)" if aside else f"'[{kind}_' || (nth) || ']'"
    # what is set aside is numbered by its place, all else by the place of the first equal value
    key = "v" if aside else same
    place = put.replace("nth", f"list_position({after}_k, y.key)")
    merged = f"{seen} || [y.key FOR y IN ys IF y.ok]"
    return f"""
{after}_m AS (SELECT *, regexp_extract_all(m, '{pattern}', 0) AS ms, regexp_split_to_array(m, '{pattern}') AS ps FROM (SELECT *, {marked} AS m FROM {before})),
{after}_v AS (SELECT *, list_transform(ms, lambda x: list_transform([{value}], lambda v: {{'pre': regexp_extract(x, '{pattern}', 1), 'v': v, 'post': regexp_extract(x, '{pattern}', 3), 'ok': {accepts}, 'key': {key}}})[1]) AS ys FROM {after}_m),
{after}_s AS (SELECT *, list_filter(ks, lambda k, j: list_position(ks, k) = j) AS {after}_k FROM (SELECT *, {merged} AS ks FROM {after}_v)),
{after} AS (SELECT * EXCLUDE (m, ms, ps, ys, ks, {after}_k, t) REPLACE ({after}_k AS {seen}{"" if aside else f", n_{kind} + len(list_filter(ys, lambda y: y.ok)) AS n_{kind}"}),
  replace(replace(array_to_string(list_transform(range(1, len(ps) + 1), lambda j: ps[j] || CASE WHEN j <= len(ys) THEN list_transform([ys[j]], lambda y: y.pre || CASE WHEN y.ok THEN {place} ELSE y.v END || y.post)[1] ELSE '' END), ''), '{MARK}', ''), '{END}', '') AS t
  FROM {after}_s)"""


def redaction(source: str, order: tuple[str, ...], may_have: str) -> str:
    """SQL of (id, redacted, found, total) for a source (id, text); `order` as the operator has it, '*' sets links and handles aside."""
    start = f"SELECT id, coalesce(text, '') AS text, coalesce(text, '') AS t, {', '.join(f'[]::VARCHAR[] AS seen_{k}, 0 AS n_{k}' for k in _KINDS)} FROM ({source})"
    ctes, last = [f"s0 AS MATERIALIZED ({start})"], "s0"
    steps = [(n, False) for n in order if n != "*"] if "*" not in order else [x for n in order for x in ([("URL", True), ("HANDLE", True)] if n == "*" else [(n, False)])]
    for i, (name, aside) in enumerate(steps, 1):
        ctes.append(_step(last, f"s{i}", name, aside))
        last = f"s{i}"
    back = f"array_to_string(list_transform(range(1, len(string_split(t, chr(4))) + 1), lambda j: CASE WHEN j = 1 THEN string_split(t, chr(4))[j] ELSE seen_aside[split_part(string_split(t, chr(4))[j], chr(5), 1)::INT] || split_part(string_split(t, chr(4))[j], chr(5), 2) END), '')"
    shown = list(dict.fromkeys(_RULES[n][0] for n, aside in steps if not aside))
    found = ", ".join(f"CASE WHEN n_{k} > 0 THEN '\"{k}\":' || n_{k} END" for k in shown)
    total = " + ".join(f"n_{k}" for k in shown)
    done = f"CASE WHEN {total} = 0 THEN text ELSE {back} END" if "*" in order else "t"
    asked = f"regexp_matches(text, '{may_have}')"
    return f"WITH {', '.join(ctes)} SELECT id, CASE WHEN {asked} THEN {done} ELSE text END AS redacted, '{{' || CASE WHEN {asked} THEN array_to_string(list_filter([{found}], lambda f: f IS NOT NULL), ',') ELSE '' END || '}}' AS found, {total} AS total FROM {last}"
