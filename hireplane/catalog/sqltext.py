"""Scalar expressions of the DuckDB check SQL."""

from __future__ import annotations

from hireplane import constants as K

SPACE = r"[\s\p{Z}\x{0085}\x0b\x1c-\x1f]"


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listing(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def ts(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def joined(expr: str) -> str:
    return f"array_to_string({expr}, '|')"


def rounded(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits})"


def stripped(expr: str) -> str:
    return f"regexp_replace({expr}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def collapsed(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{SPACE}+', ' ', 'g'))"


def any_contains(expr: str, needles) -> str:
    return "(" + " OR ".join(f"contains({expr}, {quote(n)})" for n in needles) + ")"


def target_role(title: str) -> str:
    return any_contains(f"lower(coalesce({title}, ''))", K.TARGET_KEYWORDS)


def us_location(location: str) -> str:
    loc = f"lower({location})"
    parts = f"list_transform(regexp_split_to_array({loc}, '[,/|]'), lambda p: rtrim(trim(p), '.'))"
    return (
        f"((contains({loc}, 'remote') AND {any_contains(loc, K.REMOTE_US_TOKENS)})"
        f" OR trim({loc}) = 'remote' OR {any_contains(loc, ['united states', ', usa', ' usa'])}"
        f" OR list_has_any({parts}, {listing(K.US_STATES)}))"
    )


def page_text(html: str) -> str:
    blocks = "|".join(rf"<{t}\b.*?(?:</{t}\s*>|\z)" for t in ("script", "style", "template"))
    out = f"regexp_replace(coalesce({html}, ''), '(?is){blocks}|<!--.*?-->|<![^>]*>|<\\?[^>]*>', chr(1), 'g')"
    value = "=+\\s*(?:\"[^\"]*\"|''[^'']*''|[^>\\s]*)(?:\\s*=)?"
    tag = f"</?[A-Za-z](?:[^>=/]|/=?|{value})*>"
    out = f"regexp_replace({out}, '{tag}', chr(1), 'g')"
    out = f"regexp_replace({out}, '\\x01+', chr(10), 'g')"
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return stripped(f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def without_markup(text: str) -> str:
    out = f"regexp_replace(coalesce({text}, ''), '<[^>]+>', ' ', 'g')"
    return collapsed(f"regexp_replace({out}, '&[a-z]+;', ' ', 'g')")


def employer(name: str) -> str:
    words = "|".join(K.LEGAL_WORDS)
    out = rf"regexp_replace(lower(coalesce({name}, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')"
    return collapsed(rf"regexp_replace({out}, '\b({words})\.?\b', ' ', 'gi')")


def fiscal_year(date: str) -> str:
    return f"(year({date}) + CASE WHEN month({date}) >= 10 THEN 1 ELSE 0 END)"


def steps(value: str, table, otherwise, compare: str = "<=") -> str:
    arms = " ".join(f"WHEN {value} {compare} {limit} THEN {out}" for limit, out in table)
    return f"CASE {arms} ELSE {otherwise} END"


def signal(text: str, guard: bool = False) -> str:
    low = f"lower({text})"

    def hit(patterns):
        return f"regexp_matches({low}, {quote('|'.join('(?:' + p + ')' for p in patterns))})"

    first = f"WHEN {hit(K.NEGATION_GUARD)} THEN 'negative' " if guard else ""
    return (
        f"CASE {first}WHEN {hit(K.POSITIVE_STRONG)} THEN 'positive'"
        f" WHEN {hit(K.NEGATIVE_STRONG)} THEN 'negative'"
        f" WHEN {hit(K.POSITIVE_WEAK)} THEN 'likely_positive'"
        f" WHEN {hit(K.NEGATIVE_WEAK)} THEN 'likely_negative' ELSE 'unknown' END"
    )


def lookup(expr: str, table: dict, otherwise: str = "NULL", text: bool = False) -> str:
    arms = " ".join(
        f"WHEN {quote(k)} THEN {quote(v) if text else v}" for k, v in table.items()
    )
    return f"CASE {expr} {arms} ELSE {otherwise} END"


def clamp(expr: str) -> str:
    return f"greatest({K.CONFIDENCE_FLOOR}, least({K.CONFIDENCE_CEIL}, {expr}))"


def base_score(certified: str, petitions: str, trend: str, freshness: str) -> str:
    volume = f"greatest(coalesce({certified}, 0), coalesce({petitions}, 0))"
    band = steps(volume, [(n, f"{v}::DOUBLE") for n, v in K.VOLUME_BANDS], K.VOLUME_NONE, ">=")
    adjustment = lookup(trend, {k: f"{v}::DOUBLE" for k, v in K.TREND_ADJUSTMENT.items()}, "0.0")
    return clamp(
        f"(({band}) + ({adjustment})) * (0.45::DOUBLE + 0.55::DOUBLE * coalesce({freshness}, 0.0))"
    )


def days_since(posted: str, as_of: str) -> str:
    parsed = f"try_cast(nullif(trim({posted}), '') AS TIMESTAMP)"
    seconds = f"(epoch(TIMESTAMP '{as_of}') - epoch({parsed}))"
    return (
        f"CASE WHEN {parsed} IS NULL THEN -1"
        f" ELSE CAST(greatest(0, floor({seconds} / 86400)) AS BIGINT) END"
    )


def recency(days: str) -> str:
    return f"CASE WHEN {days} < 0 THEN {K.RECENCY_UNKNOWN} ELSE {steps(days, K.RECENCY_STEPS, K.RECENCY_OLD)} END"


def contradiction_rules(signal_: str, perm: str, trend: str) -> list[tuple[str, str, float]]:
    n = K.CONTRADICTION_NOTES
    return [
        (f"{signal_} = 'positive' AND {perm} = 0", n["no_history"], -0.10),
        (f"{signal_} = 'negative' AND {perm} >= 100", n["strong_history"], 0.05),
        (f"{signal_} IN ('positive', 'likely_positive') AND {trend} = 'decreasing_sharply'", n["dropped"], -0.08),
        (f"{signal_} = 'negative' AND {trend} = 'increasing'", n["increasing"], 0.0),
    ]


def contradiction(signal_: str, perm: str, trend: str) -> tuple[str, str]:
    """SQL of the note and of the adjustment."""
    rules = contradiction_rules(signal_, perm, trend)
    note = "CASE " + " ".join(f"WHEN {c} THEN {quote(t)}" for c, t, _ in rules) + " ELSE '' END"
    adjustment = "CASE " + " ".join(f"WHEN {c} THEN {a}::DOUBLE" for c, _, a in rules) + " ELSE 0.0 END"
    return note, adjustment


def round4(expr: str) -> str:
    """Four digits, exact on the binary value, true ties to even."""
    return (
        f"list_transform([CAST({expr} AS DOUBLE)], lambda v: list_transform([floor(v * 10000)], lambda f:"
        " list_transform([(CAST(CAST(v AS FLOAT) AS DOUBLE) * 20000 - (f * 2 + 1)) + (v - CAST(CAST(v AS FLOAT) AS DOUBLE)) * 20000],"
        " lambda s: (f + CASE WHEN s > 0 OR (s = 0 AND CAST(f AS BIGINT) % 2 <> 0) THEN 1 ELSE 0 END) / 10000)[1])[1])[1]"
    )
