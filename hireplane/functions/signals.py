"""Sponsorship signal of a posting text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hireplane import constants as K
from hireplane.functions.text import contains_any


def _hits(text: Column, phrases: list[str]) -> Column:
    # One alternation per list; (?d): only \n ends a line, (?U): Unicode classes.
    return text.rlike("(?dU)(?:" + "|".join(phrases) + ")")


def sponsorship_signal(text: Column, negation_guard: bool = False) -> Column:
    """Label by the first list that hits; texts without any trigger word skip the regexes."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(~contains_any(lowered, K.SIGNAL_WORDS), "unknown")
    if negation_guard:
        out = out.when(_hits(lowered, K.NEGATION_GUARD), "negative")
    return (
        out.when(_hits(lowered, K.POSITIVE_STRONG), "positive")
        .when(_hits(lowered, K.NEGATIVE_STRONG), "negative")
        .when(_hits(lowered, K.POSITIVE_WEAK), "likely_positive")
        .when(_hits(lowered, K.NEGATIVE_WEAK), "likely_negative")
        .otherwise("unknown")
    )


def by_label(label: Column, values: dict, default=None) -> Column:
    """A literal looked up by label."""
    out = None
    for key, value in values.items():
        out = F.when(label == key, value) if out is None else out.when(label == key, value)
    return out.otherwise(default)


def signal_delta(signal: Column) -> Column:
    return by_label(signal, K.SIGNAL_DELTAS, 0.0)
