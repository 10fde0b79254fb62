"""The pipeline's stages next to plain Python on whole small tables."""

import os

import brute
import pytest

import corpus_pipeline as pipeline
from hireplane.llm import queries as Q
from hireplane.llm import quality_ranking
from hireplane.llm.samples import id_remainder

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_stages_equal_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(id_remainder("doc_id", 5) != 0)
    model = quality_ranking.fit(docs, labels)
    good = {r["doc_id"] for r in quality_ranking.score(docs, model).where("predicted = 1").collect()}
    want = {i: r for i, r in rows_of(docs).items() if i in good}

    label = brute.classes([(i, r["text"]) for i, r in want.items()])
    want = {i: r for i, r in want.items() if label[i] == i}

    cut = brute.cut([(i, r["text"]) for i, r in want.items()])
    for i, (_, removed, kept) in cut.items():
        if removed:
            want[i] |= {"text": kept, "n_chars": len(kept)}

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i in list(want):
        n, hit, _ = brute.hits(want[i]["text"], items)
        if hit and 20 * hit >= n:
            del want[i]

    copies = brute.copies([(i, r["source"]) for i, r in want.items()], Q.MIX_WEIGHTS, size=Q.MIX_SIZE, seed=Q.MIX_SEED)
    got = pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["copy"]) for r in got} == copies and len(got) == len(copies)
    for r in got:
        assert all(r[c] == want[r["doc_id"]][c] for c in columns)


def test_each_stage_keeps_the_columns(spark, docs, empty):
    names = [name for name, _ in pipeline.STAGES]
    assert len(names) == 5
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, empty, SF).count() == 0, name
    assert pipeline.STAGES[-1][1](spark, empty, SF).count() == 0


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_queries_equal_their_sql(spark, name):
    import check

    frame = lambda df: df.map(lambda v: str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else v)
    got = frame(Q.QUERIES[name](spark, SF).toPandas())
    assert len(got) and check.compare(got, frame(check.duck(SF).execute(Q.ORACLES[name]).df())) is None


def test_nothing_else_imports_this_part():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, files in os.walk(os.path.join(root, "hireplane")):
        for name in files:
            if name.endswith(".py") and os.path.basename(folder) != "llm":
                with open(os.path.join(folder, name)) as f:
                    assert "hireplane.llm" not in f.read(), name
