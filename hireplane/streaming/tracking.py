"""Incremental job tracking over a stream of bronze snapshots.

A snapshot belongs to a day and to a run of that day. Each micro-batch adds up
its rows per (day, run, job) and writes them under its own number, so a replayed
batch overwrites itself. Of every day only the latest run counts: a day that
runs again replaces what its earlier run told, also the jobs it no longer has,
as a replaced bronze file does in the batch form.

Every ``fold_every`` batches the folder is folded into one base table: rows of a
run split over batches are added up, rows of replaced runs go, and the batches
behind the base are removed. Readers take the newest finished base and the
batches after it, so a fold that breaks off changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hireplane.session import remove_folder, written_folders

FOLD_EVERY = 32
ROWS = "scrape_date DATE, run STRING, job_id STRING, first_seen TIMESTAMP, last_seen TIMESTAMP, times_seen BIGINT"
_KEYS = ["scrape_date", "run", "job_id"]


def run_counts(bronze: DataFrame, run: Column) -> DataFrame:
    """first, last and times seen per day, run and job; rows without a time are a day of their own."""
    return (
        bronze.filter(F.col("job_id").isNotNull())
        .groupBy(F.to_date("scraped_at").alias("scrape_date"), run.cast("string").alias("run"), "job_id")
        .agg(
            F.min("scraped_at").alias("first_seen"), F.max("scraped_at").alias("last_seen"),
            F.count("scraped_at").alias("times_seen"),
        )
    )


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_KEYS).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("times_seen").alias("times_seen"),
    )


def latest_runs(rows: DataFrame) -> DataFrame:
    """One row per job and day, of the day's latest run."""
    # A row per day: small, and joined by measured size.
    latest = rows.groupBy(F.col("scrape_date").alias("day")).agg(F.max("run").alias("last_run"))
    told = F.col("scrape_date").eqNullSafe(F.col("day")) & F.col("run").eqNullSafe(F.col("last_run"))
    return _added(rows.join(latest, told, "left_semi"))


def _bases(path: str) -> str:
    return path.rstrip("/") + ".bases"


def _numbered(spark: SparkSession, path: str, name: str) -> list[int]:
    return sorted(int(f.split("=")[1]) for f in written_folders(spark, path) if f.startswith(name + "="))


def tracking_rows(spark: SparkSession, path: str) -> DataFrame:
    """What the newest base and the batches after it hold."""
    bases = _numbered(spark, _bases(path), "upto")
    last = bases[-1] if bases else -1
    parts = [f"{_bases(path)}/upto={last}"] if bases else []
    parts += [f"{path}/batch={n}" for n in _numbered(spark, path, "batch") if n > last]
    return reduce(DataFrame.unionByName, [spark.read.schema(ROWS).parquet(p) for p in parts], spark.createDataFrame([], ROWS))


def fold(spark: SparkSession, path: str) -> None:
    """Put all finished batches and the base before them into a new base, and remove what it replaces."""
    bases, batches = _numbered(spark, _bases(path), "upto"), _numbered(spark, path, "batch")
    upto = max(batches, default=-1)
    if upto > max(bases, default=-1):
        latest_runs(tracking_rows(spark, path)).write.mode("overwrite").parquet(f"{_bases(path)}/upto={upto}")
        bases.append(upto)
    for n in bases[:-1]:
        remove_folder(spark, f"{_bases(path)}/upto={n}")
    for n in batches:
        if n <= bases[-1]:
            remove_folder(spark, f"{path}/batch={n}")


def start_tracking(
    bronze_stream: DataFrame, table_path: str, checkpoint: str, run_col: str | None = None,
    fold_every: int = FOLD_EVERY, **trigger,
) -> StreamingQuery:
    """Keep first seen, last seen and times seen of every job up to date under ``table_path``.

    ``run_col`` tells the runs of a day apart; the greatest as text is the
    latest. Without it all rows of a day are one run.
    """
    run = F.col(run_col) if run_col else F.lit("")

    def write(rows: DataFrame, batch: int) -> None:
        run_counts(rows, run).write.mode("overwrite").parquet(f"{table_path}/batch={batch}")
        if (batch + 1) % fold_every == 0:
            fold(rows.sparkSession, table_path)

    writer = bronze_stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start() if trigger else writer.start()


def latest_tracking(rows: DataFrame) -> DataFrame:
    """Tracking per job from ``tracking_rows``, equal to ``track_jobs`` over the latest run of every day."""
    return latest_runs(rows).groupBy("job_id").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("times_seen").alias("times_seen"),
    )
