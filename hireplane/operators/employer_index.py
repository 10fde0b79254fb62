"""The employer history stored for lookups: a few names read a few folders.

Three tables are written once per history, each dealt to folders by a hash of
what a lookup asks for: the best employer per beginning of a name, the pieces of
the names with their place, and the history rows by name. A lookup works out the
folders of its keys, of which there are at most ``BUCKETS`` numbers, and reads
these folders only; the names are not taken apart again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hireplane.operators import resolve
from hireplane.operators.filings import EMPLOYER
from hireplane.session import folders

BUCKETS = 256
_OF = "of-"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_index(history: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write the lookup tables of ``history`` under ``path``; a rerun replaces them."""
    names = resolve._names(history)
    tables = {
        ("starts", "key"): resolve.start_rows(names),
        ("pieces", "piece"): resolve.piece_rows(names, resolve.LEAST_CONTAINED),
        ("names", EMPLOYER): history.join(names, EMPLOYER),
    }
    for (name, key), rows in tables.items():
        # A piece that very many names share makes a large folder; rebalancing splits it over tasks and files.
        dealt = rows.withColumn("bucket", _bucket(key, buckets)).hint("rebalance", "bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{path}/{_OF}{buckets}/{name}")
        # The columns, for a history without rows too.
        dealt.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/{_OF}{buckets}/columns/{name}")


class EmployerIndex:
    """Lookups in the tables that ``write_index`` wrote under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        found = [f for f in folders(spark, path) if f.startswith(_OF)]
        if len(found) != 1:
            raise ValueError(f"no employer index under {path}" if not found else f"several employer indexes under {path}: {found}")
        self.path, self.buckets = f"{path}/{found[0]}", int(found[0].removeprefix(_OF))

    def rows(self, name: str, key: str, wanted: DataFrame) -> DataFrame:
        """The folders of table ``name`` that hold the ``key`` values of ``wanted``."""
        asked = wanted.select(_bucket(key, self.buckets).alias("b")).distinct().collect()
        columns = self.spark.read.parquet(f"{self.path}/columns/{name}").schema
        table = self.spark.read.schema(columns).parquet(f"{self.path}/{name}")
        return table.where(F.col("bucket").isin([r.b for r in asked])).drop("bucket")

    def resolve(self, keys: DataFrame, both_directions: bool) -> DataFrame:
        """The rows of ``resolve.resolve_names`` over the stored history."""
        keys = keys.select("key").filter("key IS NOT NULL").distinct()
        hits = self.rows("starts", "key", keys).join(keys, "key", "left_semi")
        long_keys = keys.filter(F.length("key") >= resolve.LEAST_CONTAINED)
        tiered = {3: resolve.best_containing(long_keys, self.rows("pieces", "piece", resolve.key_anchors(long_keys)))}
        if both_directions:
            starts = resolve.key_starts(keys)
            names = self.rows("names", EMPLOYER, starts).select(EMPLOYER, "best")
            tiered[2] = starts.join(names, EMPLOYER).groupBy("key").agg(F.min("best").alias("best"))
        return resolve.first_tier(hits, tiered)

    def facts(self, hits: DataFrame) -> DataFrame:
        """History rows of the employers in ``hits`` and of others that share their folders."""
        return self.rows("names", EMPLOYER, hits.where(F.col(EMPLOYER).isNotNull())).drop("best")
