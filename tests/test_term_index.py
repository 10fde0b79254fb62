"""Contained terms against Python's ``in``."""

import random

import pytest
from pyspark.sql import functions as F

from hireplane.operators import matching, term_index


def pairs(spark, texts, terms, **options):
    t = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").repartition(3)
    w = spark.createDataFrame([(x,) for x in terms], "term string")
    found = [tuple(r) for r in term_index.contained_terms(t, w, **options).collect()]
    assert len(found) == len(set(found))
    return set(found)


def wanted(texts, terms):
    return {(i, t) for i, x in enumerate(texts) for t in terms if t is not None and t in (x or "")}


def some_text(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


@pytest.mark.parametrize("alphabet", ["ab ", "aä漢 ", "a\n.*\\$[", "a?😀𝒳"])
def test_equals_in(spark, alphabet):
    rng = random.Random(len(alphabet))
    texts = [some_text(rng, alphabet, rng.choice([0, 1, 2, 5, 40, 300])) for _ in range(60)] + [None, "", "a" * 500]
    terms = [some_text(rng, alphabet, rng.choice([1, 2, 3, 4, 5, 7, 9, 13, 20, 33, 60])) for _ in range(150)]
    terms += [t[k : k + n] for t in texts if t for k, n in [(rng.randrange(len(t)), rng.choice([1, 6, 12, 31, 95, 96, 97, 200]))]]
    terms += ["", None, "", "a" * 96, "a" * 97, "a" * 600, terms[0]]
    for options in ({}, {"per_block": 40}):
        assert pairs(spark, texts, terms, **options) == wanted(texts, terms)


def test_only_odd_terms_or_none(spark):
    assert pairs(spark, ["abc", None], [""]) == {(0, ""), (1, "")}
    assert pairs(spark, ["abc"], [None]) == pairs(spark, ["abc"], []) == pairs(spark, [], ["a"]) == set()
    assert pairs(spark, ["x" * 300], ["x" * 200, "y" * 200]) == {(0, "x" * 200)}


def test_fifty_thousand_terms(spark):
    rng = random.Random(11)
    vocabulary = [some_text(rng, "abcdefghij", rng.randint(3, 9)) for _ in range(60_000)]
    terms = list(dict.fromkeys(vocabulary))[:50_000]
    # Many terms that begin alike and meet in one key.
    terms += [f"senior engineer of {w}" for w in terms[:3000]]
    texts = [" ".join(rng.choice(terms) for _ in range(120)) for _ in range(40)]
    assert pairs(spark, texts, terms) == wanted(texts, terms)


def test_texts_are_read_once_and_not_shuffled(spark, tmp_path):
    texts = [(i, f"text {i} with words") for i in range(50)]
    spark.createDataFrame(texts, "id bigint, text string").write.parquet(str(tmp_path / "texts"))
    t = spark.read.parquet(str(tmp_path / "texts"))
    w = spark.range(30_000).select(F.concat(F.lit("word"), F.col("id").cast("string")).alias("term"))
    out = term_index.contained_terms(t, w)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == plan.count("BroadcastHashJoin") == 1
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "SortMergeJoin" not in plan
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert all("window" not in line and "text" not in line for line in shuffled)


def test_keys_are_the_longest_length_a_term_has(spark):
    rows = spark.createDataFrame([("x" * n,) for n in range(1, 100)], "term string")
    got = {len(r.term): len(r.key) for r in term_index.term_index(rows).collect()}
    assert got == {n: max(k for k in term_index.KEY_LENGTHS if k <= n) for n in range(1, 97)}


def test_indexed_terms_equal_scanned_ones(spark):
    rng = random.Random(4)
    jobs = [(f"j{i}", rng.choice(["Data Engineer", "CHEF", None]), rng.choice(["Remote", "New York", None]),
             " ".join(rng.choice(["Python", "sql", "R", "go", "dbt"]) for _ in range(5)) if i % 6 else None) for i in range(80)]
    index = spark.createDataFrame(jobs, "job_id string, title string, location string, description_clean string")
    asked = spark.createDataFrame(
        [(["python", "r", "none such"], ["data engineer"], ["york"]), (["dbt", ""], [], ["remote", "paris"])],
        "skills array<string>, roles array<string>, places array<string>",
    )
    sets = lambda df: sorted((r.job_id, sorted(r.skills), sorted(r.roles), sorted(r.places)) for r in df.collect())
    scanned = sets(matching.named_terms(index, asked))
    assert sets(matching.named_terms(index, asked, most_scanned=0)) == scanned and len(scanned) == 80
