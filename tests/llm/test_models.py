"""Language, quality and toxicity models: held-out accuracy and awkward rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import prose
from pyspark.sql import functions as F

from hireplane.llm import batches as B
from hireplane.llm import language, quality_ranking, samples, toxicity
from hireplane.llm.queries import op7_language, op9_quality_classifier, op10_toxicity
from hireplane.llm.samples import id_remainder, lowest

SF = "/root/testdata/sf0.01"


def held_out_share(got, label):
    got = got[got.held_out]
    return (got.predicted == got[label]).mean()


def test_language_held_out(spark):
    got = op7_language(spark, SF).toPandas()
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    got = got.merge(lang, on="doc_id")
    assert len(got) == len(lang) and got.score.between(0, 1).all()
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.97


def test_quality_held_out(spark):
    got = op9_quality_classifier(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert held_out_share(got.merge(labels, on="doc_id"), "quality") > 0.95


def test_toxicity_held_out(spark):
    got = op10_toxicity(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert held_out_share(got.merge(labels, on="doc_id"), "toxic") > 0.93


def test_sample_is_bounded_and_repeatable(spark):
    rows = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("v"))
    a, b = (sorted(map(tuple, lowest(rows.repartition(n), "doc_id", "v", [0, 1], 20).collect())) for n in (2, 5))
    assert a == b and len(a) == 40
    assert rows.where(id_remainder("doc_id", 5) == 0).count() > 50


def test_language_awkward(docs, empty, clashing, spark):
    train = spark.createDataFrame([(i, f"el perro y la casa {i} grande", "es") for i in range(30)] + [(100 + i, f"the dog and the house {i} big", "en") for i in range(30)], "doc_id bigint, text string, lang string")
    model = language.fit(train)
    got = {r["doc_id"]: r for r in language.predict(clashing.drop("id"), model).collect()}
    assert {got[i]["lang_pred"] for i in (9, 7, 8)} == {"und"} and got[9]["score"] == 0
    assert all(r["lang_pred"] in ("en", "es") for i, r in got.items() if i not in (7, 8, 9))
    assert language.fit(empty) is None
    assert {r["lang_pred"] for r in language.predict(docs, None).collect()} == {"und"}
    assert language.predict(empty, model).count() == 0
    probe = spark.createDataFrame([(1, "THE HOUSE"), (2, "LA CASA"), (3, "1234 !!")], "doc_id bigint, text string")
    assert [r["lang_pred"] for r in language.predict(probe, model).orderBy("doc_id").collect()] == ["en", "es", "und"]


def test_language_scores_do_not_depend_on_neighbours():
    texts = ["Ärger über Öl", "", "the end", "É à", "a"]
    rng = np.random.default_rng(0)
    model = language.Model(["a", "b"], rng.normal(size=(language.BUCKETS, 2)).astype(np.float32), np.zeros(2))
    together = model.logits(*B.flat(pa.array(texts, pa.large_string())))
    alone = np.concatenate([model.logits(*B.flat(pa.array([t], pa.large_string()))) for t in texts])
    assert np.allclose(together, alone, atol=1e-4)


def test_quality_features_and_awkward(docs, empty, clashing, spark):
    texts = ["A!! B!!", "", "one two one two one two", "| x | y |", "Plain words, here."]
    together = quality_ranking.features(*B.flat(pa.array(texts, pa.large_string())))
    alone = np.concatenate([quality_ranking.features(*B.flat(pa.array([t], pa.large_string()))) for t in texts])
    assert np.allclose(together, alone)
    assert together[0][quality_ranking.FEATURES.index("bangs")] == 2 and together[1][-1] == 1
    rows = [(i, prose(i, 80), 1) if i % 2 else (i, f"{prose(i, 2)} " * 40, 0) for i in range(60)]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    model = quality_ranking.fit(train.select("doc_id", "text"), train.select("doc_id", "quality"))
    got = quality_ranking.score(train, model).join(train, "doc_id").collect()
    assert all(r["predicted"] == r["quality"] for r in got)
    out = quality_ranking.score(clashing.drop("id"), model).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    kept = quality_ranking.keep(clashing, model)
    assert kept.dtypes == clashing.dtypes
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in out if r["predicted"]}
    assert quality_ranking.fit(docs, empty.select("doc_id", F.lit(1).alias("quality"))) is None
    assert {r["score"] for r in quality_ranking.score(docs, None).collect()} == {0.5}
    assert quality_ranking.score(empty, model).count() == 0 and quality_ranking.keep(empty, model).count() == 0


def test_quality_learns_from_every_labelled_document(spark):
    """No pair is left out: a label that was not among the 3,000 lowest hashes counts, and the weights are those of all pairs."""
    rng = np.random.default_rng(5)
    rows = [(rng.normal(i % 2, 2.0, len(quality_ranking.FEATURES)).clip(0).tolist(), i % 2) for i in range(200)]
    model = quality_ranking.fit_pairs(spark.createDataFrame(rows, "x array<double>, label int").repartition(9))
    x, label = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    z = np.clip((quality_ranking.squashed(x) - model.mean) / model.scale, -8, 8)
    diff = (z[label == 1][:, None] - z[label == 0][None]).reshape(-1, z.shape[1])
    slope = diff.T @ (1 / (1 + np.exp(diff @ model.weights))) / len(diff) - quality_ranking.PENALTY * model.weights
    assert np.abs(slope).max() < 1e-4
    many = spark.range(6500).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit(1).alias("quality"))
    odd = spark.createDataFrame([(-1, "# # # |", 0), (-2, "# # # |", 0)], many.schema)
    seen = []
    fit_pairs, quality_ranking.fit_pairs = quality_ranking.fit_pairs, lambda rows: seen.append(rows.groupBy("label").count().collect())
    try:
        quality_ranking.fit(many.unionAll(odd), many.unionAll(odd))
    finally:
        quality_ranking.fit_pairs = fit_pairs
    assert sorted(map(tuple, seen[0])) == [(0, 2), (1, 6500)]


@pytest.mark.parametrize("text", ["you idiot", "you 1d10t!", "YOU ІDІОT.", "an ｉｄｉｏｔ", "id​iot", "you,idiot,you"])
def test_folding_finds_disguised_words(text):
    assert toxicity.seeds().measures(text)[0] > 0


@pytest.mark.parametrize("text", ["idiotic", "an idiot proof lock", "", "10 1 d", "maroon"])
def test_other_words_and_exceptions_do_not_match(text):
    assert toxicity.seeds().measures(text)[0] == 0


def test_toxicity_learns_words_beginnings_and_exceptions(spark, docs, empty, clashing):
    rng = random.Random(2)
    rows = []
    for i in range(480):
        bad, text = i % 4 == 0, prose(i, 40).split()
        if bad:
            text[rng.randrange(40)] = rng.choice(["zorgle", "blixen" + prose(i, 1)])
        elif i % 4 == 1:
            text[7:9] = ["zorgle", "tree"]
        rows.append((i, " ".join(text), int(bad)))
    train = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    lexicon = toxicity.fit(train.select("doc_id", "text"), train.select("doc_id", "toxic"))
    assert any(t.startswith("biix") for t in lexicon.weights)
    assert toxicity.fit(docs, empty.select("doc_id", F.lit(1).alias("toxic"))).weights == toxicity.seeds().weights
    out = toxicity.score(clashing.drop("id"), lexicon)
    assert out.count() == docs.count() and toxicity.score(empty, lexicon).count() == 0
    assert {r["predicted"] for r in toxicity.score(docs.where("doc_id in (7, 8, 9)"), lexicon).collect()} == {0}


def test_exception_phrase_takes_the_weight_back():
    lexicon = toxicity.Lexicon({"bad": 3.0, "worse*": 2.0}, ["not bad"])
    assert lexicon.measures("this is not bad at all")[0] == 0
    assert lexicon.measures("this is bad, worst")[0] == 3.0
    assert toxicity.Lexicon({"worse*": 2.0}).measures("worsens")[0] == 2.0
    assert toxicity.Lexicon({}).measures("bad")[0] == 0


def test_overlapping_exceptions_in_long_texts():
    lexicon = toxicity.Lexicon({"bad": 3.0}, ["not bad", "bad not bad", "bad hat"])
    assert lexicon.measures("bad " + "not bad " * 20_000)[0] == 0
    assert lexicon.measures("bad hat not bad so bad " * 5_000)[0] == 15_000.0


def plain_counts(text):
    """N-grams of a text by their buckets, counted one by one."""
    from collections import Counter

    raw = bytearray(text.encode())
    for i, b in enumerate(raw):
        if b < 0x80:
            raw[i] = ord(chr(b).lower()) if chr(b).isalpha() else 0x20
    for i in range(1, len(raw)):
        if raw[i - 1] == 0xC3 and 0x80 <= raw[i] <= 0x9E and raw[i] != 0x97:
            raw[i] += 0x20
    found = Counter()
    for size in language.SIZES:
        for i in range(len(raw) - size + 1):
            if raw[i : i + 2] != b"  ":
                code = int.from_bytes(raw[i : i + size], "big")
                found[((code + size) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - language.BITS)] += 1
    return found


def test_language_counts_equal_plain_python(monkeypatch):
    import random

    rng = random.Random(8)
    texts = ["", "a", " ", "É", "Über  ALL — 7 ñandú"] + ["".join(rng.choices("abÀß× \n9€x😀", k=rng.randrange(90))) for _ in range(200)]
    want = [plain_counts(t) for t in texts]
    for run, most in ((1 << 19, 64), (40, 3), (7, 64), (1, 1)):
        monkeypatch.setattr(language, "RUN", run)
        monkeypatch.setattr(language, "TEXTS_PER_RUN", most)
        got = np.concatenate(list(language.counts(*language.B.flat(pa.array(texts, pa.large_string())))))
        assert [{int(k): int(row[k]) for k in np.flatnonzero(row)} for row in got] == [dict(w) for w in want]


def test_language_memory_does_not_grow_with_the_text():
    import tracemalloc

    model = language.Model([f"l{i}" for i in range(500)], np.ones((language.BUCKETS, 500), np.float32), np.zeros(500))
    data = np.tile(np.frombuffer("Das ist ein langer Satz über nichts. ".encode(), np.uint8), 1_400_000)
    tracemalloc.start()
    best, score = model.scores(data, np.array([0, len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(data) > 50_000_000 and peak < 200_000_000 and len(best) == 1


def test_all_languages_are_learned(spark):
    rows = [(i, f"wort{i % 500:03d}x " * 9, f"l{i % 500:03d}") for i in range(1500)]
    docs = spark.createDataFrame(rows + rows[:5] + [(None, "none", "l000")], "doc_id bigint, text string, lang string")
    model = language.fit(docs)
    assert model.languages == sorted({r[2] for r in rows})
    kept = samples.lowest_of_each(docs, "doc_id", "lang", 2).groupBy("lang").count().collect()
    assert len(kept) == 500 and {r["count"] for r in kept} == {2}
    values = sorted({r[2] for r in rows})[:3]
    want = samples.lowest(spark.createDataFrame(rows, docs.schema), "doc_id", "lang", values, 2).select("doc_id", "lang").collect()
    assert set(want) == set(samples.lowest_of_each(docs, "doc_id", "lang", 2).where(F.col("lang").isin(values)).collect())
