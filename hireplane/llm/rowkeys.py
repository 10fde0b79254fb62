"""Numbers for rows that a rerun of a task gives again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``name`` (the id as text, null: empty) and ``text`` (null: empty), each partition sorted by id and text.

    Which rows a partition holds is the same in every run of its task, their
    order after a shuffle is not. Sorted, equal rows stand side by side and may
    change places without notice, so whatever counts rows of a partition counts
    alike when an executor was lost. Only these columns go on, whatever else the
    table has and however it is named.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return rows.sortWithinPartitions("id", "text")


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``settled`` rows with ``row``, a number of their own: repeated ids and repeated rows are told apart."""
    return settled(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())


def kind_of(docs: DataFrame, column: str) -> str:
    return docs.schema[column].dataType.simpleString()

