"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session, for tests and the bench only."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("hireplane")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # Little data, much work per row: keep all cores busy.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder named by ``spark.checkpoint.dir``.

    A session on one machine may leave it unset and gets a temporary folder; on
    a cluster such a folder would be another one on every executor, so there the
    setting is required. The session's settings are not changed.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _LOCAL.setdefault(app, "") or tempfile.mkdtemp(prefix="hireplane-")
        _LOCAL[app] = base
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str, finished: bool = False) -> list[str]:
    """Names of the folders below ``path``, on whatever store it is; ``finished``: of those that hold a finished table."""
    at, store = _path(spark, path)
    if not store.exists(at):
        return []
    child = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = [f.getPath() for f in store.listStatus(at) if f.isDirectory()]
    return sorted(f.getName() for f in found if not finished or store.exists(child(f, "_SUCCESS")))


def written_folders(spark: SparkSession, path: str) -> list[str]:
    return folders(spark, path, finished=True)


def first_bytes(spark: SparkSession, file: str, n: int) -> bytes:
    """Up to ``n`` bytes from the start of a file."""
    at, store = _path(spark, file)
    stream = store.open(at)
    try:
        found = [stream.read() for _ in range(n)]
    finally:
        stream.close()
    return bytes(b for b in found if b >= 0)


def remove_folder(spark: SparkSession, path: str) -> None:
    at, store = _path(spark, path)
    store.delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read from there, for tables that several passes read."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
