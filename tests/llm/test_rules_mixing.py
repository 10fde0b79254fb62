"""Quality rules and mixing next to plain Python, with awkward rows."""

import math
from collections import Counter

import brute
from pyspark.sql import functions as F

from hireplane.llm import mixing, quality_rules

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_measures_equal_plain_python(docs, awkward):
    got = {r["doc_id"]: tuple(r[m] for m in MEASURES) for r in quality_rules.ledger(docs).collect()}
    assert got == {i: brute.rule_counts(t) for i, t in awkward}


def test_bits_policies_and_ablations(docs):
    entries = quality_rules.ledger(docs).cache()
    for r in quality_rules.apply_policies(entries).collect():
        assert bool(r["failed"] & 1) == (r["n_words"] < 50)
        assert bool(r["failed"] & 2) == (100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept_base"] == (r["failed"] & 3 == 0)
        assert r["kept_v2"] == (r["failed"] == 0)
    rows = [r["failed"] for r in entries.collect()]
    for r in quality_rules.ablations(entries).collect():
        full = quality_rules.mask(quality_rules.POLICIES[r["policy"]])
        rest = full & ~quality_rules.mask([r["without"]])
        assert (r["kept"], r["kept_without"]) == (sum(f & full == 0 for f in rows), sum(f & rest == 0 for f in rows))


def test_rules_are_native_and_need_no_shuffle(docs, empty, clashing):
    plan = quality_rules.ledger(docs.coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") <= 1
    assert quality_rules.ledger(empty).count() == 0
    assert {r["kept"] for r in quality_rules.ablations(quality_rules.ledger(empty)).collect()} == {0}
    assert quality_rules.ledger(clashing).count() == clashing.count()


def test_copies_equal_plain_python(docs, spark):
    weights = {"s0": 3.0, "s1": 0.0}
    rows = [(r["doc_id"], r["source"]) for r in docs.collect()]
    got = {(r["doc_id"], r["copy"]) for r in mixing.mix(docs, weights, size=2.5).collect()}
    assert got == brute.copies(rows, weights, size=2.5)
    assert not any(dict(rows)[i] == "s1" for i, _ in got)


def test_mixing_meets_the_weights_in_random_order(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "a").otherwise("b").alias("source"))
    out = mixing.mix(docs, {"a": 1.0, "b": 3.0}, size=2.0).collect()
    share = Counter(r["source"] for r in out)
    assert abs(len(out) - 12000) < 500 and abs(share["b"] / len(out) - 0.75) < 0.02
    assert [r["shuffle_key"] for r in out] == sorted(r["shuffle_key"] for r in out)
    half = [r["doc_id"] for r in out[: len(out) // 2]]
    assert abs(sum(half) / len(half) - 3000) < 150


def test_many_sources_take_the_salted_join(docs, monkeypatch):
    want = sorted(map(tuple, mixing.mix(docs, {"s0": 2.0}).select("doc_id", "copy").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(tuple, mixing.mix(docs, {"s0": 2.0}).select("doc_id", "copy").collect())) == want


def test_large_rates(spark):
    """Rates of 300 to 4000, where exp(-rate) is no longer a double: counts are the inverse distribution at the same numbers."""
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("source"))
    weights = {"s0": 3.0, "s1": 10.0, "s2": 20.0, "s3": 40.0}
    counts = {r["doc_id"]: r["_count"] for r in mixing.counted(docs, weights, size=1825.0).collect()}
    for r in docs.withColumn("u", mixing.unit(17, F.col("doc_id"))).collect():
        rate = weights[r["source"]] / 73 * 1825 * 4
        total, k = 0.0, -1
        while total <= r["u"]:
            k += 1
            total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        assert counts[r["doc_id"]] == k
    assert mixing.mix(docs.limit(1), {"s0": 1.0}, size=5000.0).count() > 4000


def test_mixing_awkward(docs, empty, clashing, spark):
    assert mixing.mix(empty).count() == 0
    out = mixing.mix(clashing, {"s0": 2.0})
    assert set(out.columns) == set(clashing.columns) and dict(out.dtypes)["copy"] == "int"
    twice = mixing.mix(docs.unionAll(docs), {"s0": 2.0}, size=1.0)
    n = Counter((r["doc_id"], r["copy"]) for r in twice.collect())
    assert set(n.values()) == {2}
    nulls = spark.createDataFrame([(None, "t", None)], "doc_id bigint, text string, source string")
    assert mixing.mix(nulls, size=50.0).count() > 0
