"""Registered queries of this subpackage: each operator on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hireplane.llm import (
    decontamination, fill_in_middle, language, mixing, packing, preferences, quality_ranking, quality_rules, simhash,
    substrings, toxicity, whitening, wrappers,
)
from hireplane.llm.oracles import ORACLES  # noqa: F401
from hireplane.llm.samples import id_remainder

#: Wanted shares of the output by source; a source that is not listed counts 1.
MIX_WEIGHTS = {"src0": 2.0, "src1": 3.0, "src2": 0.5}
MIX_SIZE = 1.0
MIX_SEED = 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(table(spark, sf_dir, "documents"))
    base = quality_rules.passes(quality_rules.POLICIES["base"])
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~base).alias("base_failed"), quality_rules.passes(quality_rules.POLICIES["v2"]).alias("kept"), "failed",
    )


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, size=MIX_SIZE, seed=MIX_SEED)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preferences.swapped_replies(table(spark, sf_dir, "conversations"))
    done = preferences.format_pairs(pairs)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), "|").alias(c)
    return done.select(*[text(c) if c.endswith(("_texts", "_masks")) else c for c in done.columns])


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 3) == 1
    model = language.fit(docs.where(~held_out))
    return language.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = wrappers.extract(table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = id_remainder("doc_id", 5) == 0
    model = quality_ranking.fit(docs, labels.where(~held_out))
    return quality_ranking.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = id_remainder("doc_id", 5) == 0
    lexicon = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.score(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", "predicted", "weight", "rate")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle.digests(fill_in_middle.output_pieces(table(spark, sf_dir, "documents")))
    return done.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    done = whitening.whiten(vectors, whitening.fit(vectors))
    each = done.select("*", F.posexplode("whitened").alias("place", "value"))
    return each.select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", F.col("deviation").try_cast("bigint").alias("deviation"),
        F.col("value").alias("whitened"), F.get("explained", F.col("place")).alias("explained"), "identity_error",
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
        "offset", "context", "step_group",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_quality_rules, op3_mix_sources, op4_substring_dedup, op5_simhash, op6_chat_preferences,
        op7_language, op8_html_text, op9_quality_classifier, op10_toxicity, op11_fill_in_middle, op12_whitening, op13_packing,
    )
}
