"""Registered queries and the DuckDB SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hireplane.catalog.bindings import DuckDB, Inputs, with_inputs
from hireplane.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DERIVED: dict[str, tuple[list[str], str]] = {}


def register(name: str, oracle: tuple[list[str], str] | None = None):
    """Decorate a function of ``Inputs``; ``oracle`` is (inputs, SELECT)."""

    def add(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plain(fn(Inputs(spark, sf_dir)))
        if oracle is not None:
            ORACLES[name] = with_inputs(DuckDB(), oracle[0], oracle[1], DERIVED)
        return fn

    return add


_STORED: dict[tuple[str, str, str], tuple[str, T.StructType]] = {}


def stored(i: Inputs, name: str, build: Callable[[Inputs], DataFrame]) -> DataFrame:
    """A finished table, written once per session to the shared folder and read from there.

    Queries that serve from silver tables read them as files, as users do; the
    build queries themselves do not go through here.
    """
    key = (i.spark.sparkContext.applicationId, i.dialect.sf_dir, name)
    if key not in _STORED:
        path = scratch_path(i.spark, name)
        table = build(i)
        table.write.option("compression", "zstd").parquet(path)
        _STORED[key] = (path, table.schema)
    path, schema = _STORED[key]
    return i.spark.read.schema(schema).parquet(path)


def plain(df: DataFrame) -> DataFrame:
    """Lists, maps and times as text, doubles to 6 digits, so values compare across engines."""
    columns = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, T.ArrayType):
            col = F.array_join(col, "|")
        elif isinstance(kind, (T.MapType, T.StructType)):
            col = F.to_json(col)
        elif isinstance(kind, T.TimestampType):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.DateType):
            col = col.cast("string")
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            col = F.round(col.cast("double"), 6)
        elif isinstance(kind, (T.IntegerType, T.ShortType)):
            col = col.cast("bigint")
        columns.append(col.alias(field.name))
    return df.select(*columns)
