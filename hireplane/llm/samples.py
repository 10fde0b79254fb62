"""Bounded, repeatable samples of labelled rows to fit a model on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def id_remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(divisor))


def lowest(rows: DataFrame, key: str, label: str, values: list, most: int) -> DataFrame:
    """At most ``most`` rows of each label value, those with the lowest hash of ``key``: a top-k, not a sort."""
    parts = [
        rows.where(F.col(label) == value).orderBy(F.xxhash64(F.lit(31), key), key).limit(most) for value in values
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def lowest_of_each(rows: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """(key, label) of at most ``most`` keys of every label value, those with the lowest hash; null keys are left out.

    One pass for any number of values. Rows that repeat a key are one before they
    are ranked, and each value's are ranked by salt first, so no value meets whole in one task.
    """
    ranked = rows.where(F.col(key).isNotNull()).select(key, label).dropDuplicates().withColumn("_hash", F.xxhash64(F.lit(31), key))
    ranked = ranked.withColumn("_salt", F.pmod("_hash", F.lit(64)))
    for by in ((label, "_salt"), (label,)):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("_hash", key))
        ranked = ranked.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")
    return ranked.select(key, label)
