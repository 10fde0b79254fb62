"""Text columns: HTML to text, whitespace, title and location predicates, names."""

from __future__ import annotations

import html
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hireplane import constants as K

# White space as Python's str.strip() and regex \s see it.
WS_CLASS = r"[\s\x1c-\x1f]"
WS_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# A tag: its name, then characters and values; each part is taken whole, so a search never goes back.
# An equals sign behind a slash or a value begins a name.
TAG = r"""</?[A-Za-z](?:[^>=/]++|/=?+|=++\s*+(?:"[^"]*+"|'[^']*+'|[^>\s]*+)(?:\s*+=)?+)*+>"""
# Named entities decoded without leaving the JVM; "amp" has to come last.
COMMON_ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0", "copy": "©", "reg": "®",
    "trade": "™", "middot": "·", "bull": "•", "hellip": "…", "ndash": "–", "mdash": "—",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "#39": "'", "#x27": "'", "amp": "&",
}


def literal(values: list, kind: str = "array<string>") -> Column:
    """A constant list; built in one call and folded by the optimizer."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where ``body`` loops over it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for cond in conditions[1:]:
        out = out | cond
    return out


def contains_any(col: Column, needles: list[str]) -> Column:
    return any_of([F.contains(col, F.lit(n)) for n in needles])


def contains_all(col: Column, needles: list[str]) -> Column:
    return ~any_of([~F.contains(col, F.lit(n)) for n in needles])


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WS_CHARS))


def collapse(col: Column) -> Column:
    """Runs of white space become one blank; ends trimmed."""
    return F.trim(F.regexp_replace(col, f"(?U){WS_CLASS}+", " "))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as a real column.

    Filters and projections that use an alias several times may be rewritten
    to repeat its expression; a generated column is never taken apart.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def decode_entities(col: Column) -> Column:
    """All HTML entities.

    Rows holding nothing but common entities stay in the JVM; only the others
    are handed to Python (NULL is sent for the rest, so little data moves).
    """
    names = "|".join(COMMON_ENTITIES)
    rare = F.contains(col, F.lit("&")) & F.regexp_replace(col, f"&(?:{names});", "").rlike(
        "&#?[0-9A-Za-z]"
    )
    native = col
    for name, char in COMMON_ENTITIES.items():
        native = F.replace(native, F.lit(f"&{name};"), F.lit(char))
    return F.coalesce(_unescape(F.when(rare, col)), native)


def text_nodes(raw: Column) -> Column:
    """Tags to newlines; script, style, comments, doctype and processing instructions dropped.

    A quoted attribute value may hold ``>``; a quote opens a value only after
    ``=``, anywhere else it is a character like others. An unclosed script,
    style or template ends with the text.
    """
    mark = "\u0001"
    col = F.coalesce(raw, F.lit(""))
    col = F.regexp_replace(
        col, r"(?is)<(script|style|template)\b.*?(?:</\1\s*>|\z)|<!--.*?-->|<![^>]*>|<\?[^>]*>", mark
    )
    col = F.regexp_replace(col, TAG, mark)
    return F.regexp_replace(col, f"{mark}+", "\n")


def add_html_text(df: DataFrame, html_column: str, name: str) -> DataFrame:
    """``df`` with the text nodes of an HTML column, joined by newlines, as ``name``.

    Plain columns, so nothing is computed where ``name`` is not read: the nodes are
    named several times, which keeps the optimizer from repeating their expression.
    """
    nodes = df.withColumn("_nodes", text_nodes(F.col(html_column)))
    decoded = decode_entities(F.col("_nodes"))
    return nodes.withColumn(
        name, strip(F.regexp_replace(decoded, r"\n{3,}", "\n\n"))
    ).drop("_nodes")


def strip_markup(text: Column) -> Column:
    """Residual tags and lower-case entities to blanks, white space collapsed."""
    col = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " ")
    col = F.regexp_replace(col, r"&[a-z]+;", " ")
    return collapse(col)


def head(col: Column, max_chars: int | None) -> Column:
    """The whole text, or its first ``max_chars`` characters if a limit is asked for."""
    return col if max_chars is None else F.substring(col, 1, max_chars)


def is_target_role(title: Column) -> Column:
    return contains_any(F.lower(F.coalesce(title, F.lit(""))), K.TARGET_KEYWORDS)


def is_us_location(location: Column) -> Column:
    loc = F.lower(F.coalesce(location, F.lit("")))
    parts = F.transform(F.split(loc, r"[,/|]"), lambda p: F.rtrim(strip(p), F.lit(".")))
    return (
        (F.contains(loc, F.lit("remote")) & contains_any(loc, K.REMOTE_US_TOKENS))
        | (strip(loc) == "remote")
        | contains_any(loc, ["united states", ", usa", " usa"])
        | F.arrays_overlap(parts, literal(K.US_STATES))
    )


def normalize_company(name: Column) -> Column:
    """Lower case, punctuation to blanks, legal words dropped wherever they stand."""
    words = "|".join(K.LEGAL_WORDS)
    col = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)[^\w\s]", " ")
    col = F.regexp_replace(col, rf"(?iU)\b({words})\.?\b", " ")
    return collapse(col)


def job_text(title: Column, slug: Column, description: Column, max_chars: int | None = None) -> Column:
    """Text a job vector is made from."""
    return F.concat(
        F.coalesce(title, F.lit("")), F.lit(" at "), F.coalesce(slug, F.lit("")), F.lit(". "),
        head(strip_markup(description), max_chars),
    )


def candidate_text(
    skills: Column, titles: Column, target_roles: Column, best_fit_roles: Column,
    years: Column, degree: Column, summary: Column,
) -> Column:
    """Text a candidate vector is made from; absent parts leave their blank."""
    roles = F.when(F.size(target_roles) > 0, target_roles).otherwise(best_fit_roles)
    experience = F.when(
        F.coalesce(years, F.lit(0.0)) != 0,
        F.concat(years.cast("long").cast("string"), F.lit(" years experience")),
    ).otherwise("")
    blank = F.lit("")
    return F.concat_ws(
        " ", F.array_join(roles, " "), F.array_join(titles, " "), experience,
        F.coalesce(degree, blank), F.array_join(skills, " "), F.coalesce(summary, blank),
    )
