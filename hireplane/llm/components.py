"""Connected components of a link table as Spark joins, and stored intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hireplane.session import scratch_path

MOST_ROUNDS = 60


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read from there, which cuts its lineage for good."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to (node, component), the least node that can be reached; that node itself has no row.

    Large-star and small-star steps in turn: each node's neighbours are hung on
    the least node known around it until nothing changes, in logarithmically
    many rounds. A node's minimum is a map-side aggregate and goes back by a
    join, so no neighbourhood is gathered in one task. Null ends are dropped; an empty table gives none.
    """
    a, b = F.col("a"), F.col("b")
    edges = stored(
        links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links",
    )
    before = None
    for _ in range(MOST_ROUNDS):
        both = edges.select("a", "b").unionAll(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        hung = both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        low = hung.groupBy("a").agg(F.min("b").alias("m"))
        met = hung.join(low, "a")
        edges = stored(
            met.where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
            .unionAll(met.select("a", F.col("m").alias("b"))).distinct(), "links",
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
    raise RuntimeError(f"components not stable after {MOST_ROUNDS} rounds")
