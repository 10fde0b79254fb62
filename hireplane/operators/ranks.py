"""Numbers of rows by the order of a key, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hireplane.session import stored


def ranked(df: DataFrame, keys: list[str], name: str = "rank") -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... by the order of ``keys``, nulls first; rows with equal keys in any order.

    Rows are dealt to ranges of the key and written with their range, so that all
    passes see the same ranges. A row's number is that within its range plus the
    sizes of the ranges before, of which there are as many as partitions.
    """
    in_range = df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys])
    kept = stored(in_range.withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = kept.groupBy("_range").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_range").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    numbered = kept.withColumn(name, F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(starts), "_range").withColumn(name, F.col(name) + F.col("_start")).drop("_range", "_start")
