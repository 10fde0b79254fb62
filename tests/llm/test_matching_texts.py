"""Decontamination, SimHash and substring dedup next to brute force, with awkward rows."""

import hashlib
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from brute import WORDS, prose
from pyspark.sql import functions as F

from hireplane.llm import decontamination, simhash, substrings
from hireplane.llm.components import connected


@pytest.fixture(scope="module")
def items(spark, awkward):
    text = dict(awkward)
    words = text[10].split()
    rows = [
        (1, " ".join(words[5:40])), (2, text[12][100:400]), (3, "two words"), (4, None), (5, "..."), (6, "ONE"), (7, " ".join(words[20:33])),
        (8, text[12][300:500].upper()), (8, "kaban"), (None, prose(6, 15)), (9, "a b c a b c d e"), (10, "漢字 テスト"),
    ]
    return rows, spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.mark.parametrize("block_chars", [10**6, 150])
def test_hits_equal_brute_force(docs, awkward, items, block_chars):
    rows, table = items
    known = [(i, t) for i, t in rows if i is not None]
    got = {r["doc_id"]: r for r in decontamination.hits(docs, table, block_chars=block_chars).collect()}
    for i, t in awkward:
        n, hit, _ = brute.hits(t, rows)
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["items"]) == (n, hit, brute.hits(t, known)[2])
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_random_hits(spark):
    rng = random.Random(4)
    few = WORDS[:3]
    rows = [(i, " ".join(rng.choice(few) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    items = [(i, " ".join(rng.choice(few) for _ in range(rng.randint(1, 30)))) for i in range(12)]
    got = decontamination.hits(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), window=7)
    for r in got.collect():
        assert (r["n_words"], r["n_hit"], r["items"]) == brute.hits(dict(rows)[r["doc_id"]], items, 7)


def test_clean_and_cut(docs, items, empty, clashing, spark):
    _, table = items
    hits = {r["doc_id"]: r for r in decontamination.hits(docs, table).collect()}
    kept = decontamination.clean(clashing, table)
    assert kept.columns == clashing.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in hits.items() if not r["contaminated"]}
    rest = {r["doc_id"]: r for r in decontamination.cut(docs, table).collect()}
    for i, r in hits.items():
        n = len(brute.ALNUM.findall(brute.lower(rest[i]["text"])))
        assert (r["n_words"] - r["n_hit"], r["n_hit"]) == (n, rest[i]["n_hit"])
    assert decontamination.hits(empty, table).count() == 0
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.hits(docs, none).where("n_hit > 0").count() == 0
    assert decontamination.clean(docs, none).count() == docs.count()


def test_suffix_automaton_knows_all_substrings():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab") for _ in range(20)) for _ in range(5)]
    auto = decontamination.Automaton([str(i) for i in range(5)], texts, window=4)
    numbers = {w: int(auto.numbers(decontamination.words_of(np.frombuffer(w.encode(), np.uint8), np.array([0, 1]))[0])[0]) for w in "ab"}
    for _ in range(200):
        probe = [rng.choice("ab") for _ in range(6)]
        ranges, found = auto.stream([numbers[w] for w in probe])
        want = {i for i in range(3) for t in texts if " ".join(probe[i : i + 4]) in t}
        assert {a for a, _ in ranges} == want
        assert found == {n for n, t in enumerate(texts) for i in want if " ".join(probe[i : i + 4]) in t}


@pytest.mark.parametrize("crowd", [64, 2])
def test_classes_equal_brute_force(docs, awkward, crowd):
    got = {r["doc_id"]: r for r in simhash.classes(docs, crowd=crowd).collect()}
    want = brute.classes(awkward)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["fp"] % 2**64 == brute.fingerprint(dict(awkward)[i]) for i, r in got.items())


@pytest.mark.parametrize(("n_segments", "crowd"), [(3, 64), (3, 3), (2, 64), (4, 5)])
def test_links_connect_like_all_pairs(spark, n_segments, crowd):
    rng = random.Random(n_segments * 100 + crowd)
    centres = [rng.getrandbits(64) for _ in range(8)] + [0, 2**64 - 1]
    prints = {c for c in centres}
    for c in centres:
        for _ in range(60):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 9)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    table = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in prints], "fp bigint")
    found = connected(simhash.links(table, n_segments=n_segments, crowd=crowd)).collect()
    label = {x: x for x in prints}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, x in enumerate(prints):
        for y in prints[i + 1 :]:
            if (x ^ y).bit_count() <= 4:
                label[root(x)] = root(y)
    want = {}
    for x in prints:
        want.setdefault(root(x), set()).add(x)
    got = {}
    for r in found:
        got.setdefault(r["component"], {r["component"] % 2**64}).add(r["node"] % 2**64)
    assert {frozenset(s) for s in got.values()} == {frozenset(s) for s in want.values() if len(s) > 1}


def test_number_of_parts():
    assert [simhash.parts_for(n) for n in (0, 10**6, 10**8, 10**9, 10**12)] == [3, 3, 3, 2, 2]
    assert [simhash.parts_for(10, distance) for distance in (1, 2, 3, 5, 7)] == [2, 2, 2, 3, 4]


def test_components_of_chains_and_repeats(spark):
    chain = [(i, i + 1) for i in range(200)] + [(300, 301), (301, 300), (5, 5), (None, 4), (301, 300)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[301] == 300
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_representatives(docs, awkward, empty, clashing):
    want = {v for v in brute.classes(awkward).values()}
    kept = simhash.representatives(clashing)
    assert kept.columns == clashing.columns and {r["doc_id"] for r in kept.collect()} == want
    assert simhash.representatives(empty).count() == 0 and simhash.classes(empty).count() == 0
    assert simhash.representatives(docs.unionAll(docs)).select("doc_id").distinct().count() == len(want)


def test_rows_that_share_an_id_are_judged_each_by_its_text(spark, docs):
    dirty, clean = prose(61, 40), [prose(62, 40), prose(63, 40)]
    rows = [(None, dirty), (None, clean[0]), (None, None), (7, dirty), (7, clean[1]), (8, clean[0])]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], docs.schema).withColumns({c: F.lit("mine") for c in ("key", "digest", "_id")})
    items = spark.createDataFrame([(1, dirty[:150])], "item_id bigint, text string")
    got = [(r.doc_id, r.text) for r in decontamination.clean(df, items).collect()]
    assert sorted(got, key=str) == sorted([(None, clean[0]), (None, None), (7, clean[1]), (8, clean[0])], key=str)


def test_documents_without_an_id_are_kept(spark, docs, awkward):
    """Different texts all stay, copies of a document with an id go, copies of each other leave one."""
    copy = next(t for i, t in awkward if i == 14)
    more = [prose(51, 80), prose(52, 80), prose(53, 80), prose(53, 80), copy]
    unnamed = spark.createDataFrame([(None, t, "en", "s", len(t)) for t in more], docs.schema)
    kept = [(r.doc_id, r.text) for r in simhash.representatives(docs.unionAll(unnamed)).collect()]
    alone = [(r.doc_id, r.text) for r in simhash.representatives(docs).collect()]
    assert sorted(kept, key=str) == sorted([*alone, *[(None, t) for t in dict.fromkeys(more[:4])]], key=str)


def test_representatives_of_repeated_rows(docs, awkward, empty):
    from pyspark.sql import functions as F

    want = {v for v in brute.classes(awkward).values()}
    twice = simhash.representatives(docs.unionAll(docs)).collect()
    assert len(twice) == len(want) and {r["doc_id"] for r in twice} == want
    changed = docs.unionAll(docs.where("doc_id in (2, 6)").withColumn("text", F.lit("another text"))).unionAll(docs.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))
    one = simhash.one_row_per_id(changed.unionAll(changed))
    assert one.columns == docs.columns and one.count() == docs.count() + 1
    assert sorted(map(str, one.collect())) == sorted(map(str, simhash.one_row_per_id(changed.repartition(7)).collect()))
    assert simhash.one_row_per_id(empty).count() == 0


def test_cut_equals_brute_force(docs, awkward):
    want = brute.cut(awkward)
    for r in substrings.cut_repeats(docs).collect():
        assert (r["n_words"], r["n_removed"], r["kept"]) == want[r["doc_id"]]
    assert sum(w[1] for w in want.values()) > 500


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_cuts(spark, seed):
    """Passages of 30 to 120 words copied between texts, whole, overlapping, and with single words changed."""
    rng = random.Random(seed)
    pool = [prose(1000 * seed + i, 120).split() for i in range(6)]
    rows = []
    for i in rng.sample(range(1000), 60):
        words = prose(seed * 5000 + i, rng.randint(0, 60)).split()
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool)
            a = rng.randint(0, 80)
            part = p[a : a + rng.randint(30, 120)]
            if part and rng.random() < 0.5:
                part = part[:]
                part[rng.randrange(len(part))] = "changed"
            words += part + prose(seed * 7000 + i, rng.randint(0, 12)).split()
        rows.append((i, " ".join(words)))
    want = brute.cut(rows)
    got = substrings.cut_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == want


def test_without_repeats(docs, awkward, empty, clashing, spark):
    want, text = brute.cut(awkward), dict(awkward)
    out = substrings.without_repeats(clashing)
    assert out.dtypes == clashing.dtypes
    for r in out.collect():
        n, removed, kept = want[r["doc_id"]]
        assert r["text"] == (kept if removed else text[r["doc_id"]]) and r["rest"] == "mine"
        if removed:
            assert r["n_chars"] == len(kept)
    assert substrings.without_repeats(empty).count() == 0 and substrings.cut_repeats(empty).count() == 0
    nulls = docs.unionAll(docs.select(F.lit(None).cast("bigint"), "text", "lang", "source", "n_chars").where("doc_id = 12"))
    lost = {r["doc_id"]: r["n_removed"] for r in substrings.cut_repeats(nulls).collect()}
    assert lost[None] == 0 and lost[6] == want[6][1]
    twice = substrings.cut_repeats(docs.unionAll(docs)).collect()
    assert len(twice) == 2 * len(awkward) and all(r["n_removed"] == want[r["doc_id"]][1] for r in twice)


def test_texts_are_shuffled_once(docs, tmp_path):
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "d"))
    out = substrings.cut_repeats(docs.sparkSession.read.parquet(str(tmp_path / "d")))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_piece_boundaries():
    from hireplane.llm import batches as B

    texts = ["ab", "", "cd ef", " gh", "ij "]
    data, offsets = B.flat(pa.array(texts, pa.large_string()))
    starts, ends, first = B.word_spans(data, offsets, B.SPACED)
    words = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert [words[a:b] for a, b in zip(first[:-1], first[1:])] == [t.split() for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    assert [t for p in B.pieces([batch], "text", 3) for t in p.column("text").to_pylist()] == texts
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


def test_paths_are_verified_at_their_source(spark, monkeypatch):
    words = [f"w{i}" for i in range(180)]
    rows = [(1, " ".join(words[:90])), (2, " ".join(words[90:])), (3, " ".join(words[:90]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    # Whatever the graph says, words go only where the texts are alike.
    monkeypatch.setattr(substrings, "paths", lambda rows: rows.select("id", F.lit(10).alias("start"), F.lit(80).alias("stop")))
    lost = {r["doc_id"]: r["n_removed"] for r in substrings.cut_repeats(docs).collect()}
    # Windows over the ends of the path are alike as well, where their own edges are known.
    assert lost[1] == lost[2] == 0 and 70 <= lost[3] <= 90


def test_edges_meet_their_places_in_a_join_of_two_shuffles(spark):
    import re

    docs = spark.createDataFrame([(i, "a b c " * 40) for i in range(9)], "id bigint, text string")
    plan = substrings.paths(docs)._jdf.queryExecution().executedPlan().toString()
    join = plan[re.search("SortMergeJoin|ShuffledHashJoin", plan).start():]
    assert join.index("Exchange") < join.index("HashAggregate")
