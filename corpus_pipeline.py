"""The corpus pipeline: documents to a cleaned, deduplicated, mixed training set.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and
returns the columns of documents (the last one adds ``copy`` and
``shuffle_key``). ``run`` writes every stage as Parquet to the shared folder
and hands the stored rows to the next, so a lost executor never reaches back
beyond the stage it worked on.

Quality labels are learned from ``labels`` as the quality query does. Null
texts are scored, linked and cut like empty ones; rows that repeat an id are
one document; an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hireplane.llm import decontamination, mixing, quality_ranking, simhash, substrings
from hireplane.llm.components import stored
from hireplane.llm.queries import MIX_SEED, MIX_SIZE, MIX_WEIGHTS, table
from hireplane.llm.samples import id_remainder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking predicts to be good."""
    labels = table(spark, sf_dir, "labels").where(id_remainder("doc_id", 5) != 0)
    return quality_ranking.keep(docs, quality_ranking.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class: the one with the least id."""
    return simhash.representatives(docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words that a document with a smaller id has."""
    return substrings.without_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by test items."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents by the target weights of their sources, in random order."""
    return mixing.mix(docs, MIX_WEIGHTS, size=MIX_SIZE, seed=MIX_SEED)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_substrings),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
]

#: The first stages learn a model and hash shingles, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
    return docs
