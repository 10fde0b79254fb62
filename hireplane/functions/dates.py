"""Dates: fiscal years, lenient parsing, posting age."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from hireplane import constants as K


def as_of_column(as_of: datetime | str) -> Column:
    text = as_of if isinstance(as_of, str) else as_of.strftime("%Y-%m-%d %H:%M:%S")
    return F.to_timestamp(F.lit(text))


def fiscal_year(date: Column) -> Column:
    """October starts the next fiscal year; NULL stays NULL."""
    return F.year(date) + (F.month(date) >= 10).cast("int")


def current_fiscal_year(as_of: datetime | str) -> int:
    if isinstance(as_of, str):
        as_of = datetime.fromisoformat(as_of)
    return as_of.year + (1 if as_of.month >= 10 else 0)


def lenient_timestamp(col: Column) -> Column:
    """Timestamp of a date, timestamp or text; NULL where the text is no date."""
    text = col.cast("string")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("M/d/yyyy")))


def epoch_ms_to_iso(ms: Column) -> Column:
    """Epoch milliseconds as ISO text in UTC; '' for 0 and NULL."""
    utc = F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone())
    millis = F.pmod(ms, F.lit(1000))
    fraction = F.when(millis == 0, "").otherwise(
        F.concat(F.lit("."), F.lpad(millis.cast("string"), 3, "0"), F.lit("000"))
    )
    return F.when(F.coalesce(ms, F.lit(0)) == 0, "").otherwise(
        F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))
    )


def freshness(last_date: Column, current_fy: int) -> Column:
    age = F.lit(current_fy) - fiscal_year(last_date)
    out = F.when(last_date.isNull(), 0.0)
    for limit, value in K.FRESHNESS_STEPS:
        out = out.when(age <= limit, value)
    return out.otherwise(K.FRESHNESS_OLD)


def days_since(posted_at: Column, as_of: datetime | str) -> Column:
    """Whole days since posting, never negative; -1 where the text is no date."""
    posted = F.try_to_timestamp(blank_ok(posted_at))
    micros = F.unix_micros(as_of_column(as_of)) - F.unix_micros(posted)
    days = F.greatest(F.lit(0), F.floor(micros / F.lit(86_400_000_000))).cast("int")
    return F.when(posted.isNull(), -1).otherwise(days)


def blank_ok(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def recency(days: Column) -> Column:
    out = F.when(days < 0, K.RECENCY_UNKNOWN)
    for limit, value in K.RECENCY_STEPS:
        out = out.when(days <= limit, value)
    return out.otherwise(K.RECENCY_OLD)
