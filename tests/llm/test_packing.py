"""Packing: ids as the tokenizer gives them, every id once, windows full, steps alike."""

import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pytest
from brute import prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hireplane.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def rows_of(df, **options):
    return [r.asDict() for r in packing.pack(df, PATH, **options).collect()]


def ids_of(row):
    return array("I", bytes(row["ids"])).tolist()


def check(rows, wanted, tiers=packing.TIERS):
    """Every document's ids are there once and in order, every sequence is gapless and has its context size."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] == len(ids_of(r)) > 0
        by_doc[r["id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, pieces in by_doc.items():
        found = [x for r in sorted(pieces, key=lambda r: r["start"]) for x in ids_of(r)]
        assert found == wanted[doc] and {r["doc_tokens"] for r in pieces} == {len(found)}
        ends = sorted((r["start"], r["start"] + r["length"]) for r in pieces)
        assert [a for a, _ in ends] == [0, *[b for _, b in ends[:-1]]]
    assert by_doc.keys() == wanted.keys()
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        total = 0
        for r in pieces:
            assert r["offset"] == total
            total += r["length"]
        assert {r["context"] for r in pieces} == {total} and len({r["step_group"] for r in pieces}) == 1
        assert total in packing.tail_sizes(tiers)
    return by_sequence


def test_every_id_once(spark, docs, awkward, whole):
    wanted = {i: whole(t) for i, t in awkward}
    for options in ({}, {"block": 500}, {"block": 1, "tiers": (64, 32, 16)}, {"tiers": (128,)}):
        rows = rows_of(docs, **options)
        check(rows, wanted, options.get("tiers", packing.TIERS))
    assert rows_of(docs, end_id=7)[0]["ids"] is not None


def test_tiers_take_what_fits(spark, whole):
    """A long document gives whole windows; gaps of long windows are filled by short documents, uncut where they fit."""
    rng = random.Random(1)
    texts = [(i, prose(i, rng.choice([5, 30, 200, 420, 900, 3000]))) for i in range(400)]
    rows = rows_of(spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1))
    sequences = check(rows, {i: whole(t) for i, t in texts})
    sizes = [s[0]["context"] for s in sequences.values()]
    assert sum(s not in packing.TIERS for s in sizes) <= 8
    assert sum(s == 2048 for s in sizes) > 10
    for pieces in sequences.values():
        if pieces[0]["context"] == 2048 and len(pieces) > 1:
            assert pieces[0]["length"] >= max(p["length"] for p in pieces)
    cuts = defaultdict(int)
    for r in rows:
        cuts[r["id"]] += 1
    assert sum(n > 1 + r_tokens // 2048 for n, r_tokens in ((cuts[i], len(whole(t))) for i, t in texts)) < len(sequences) * 2


def test_step_groups_cost_the_same(spark):
    texts = [(i, prose(i, 40 + 13 * (i % 60))) for i in range(1500)]
    rows = rows_of(spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1), step=16 * 2048)
    loads, members = defaultdict(int), defaultdict(set)
    for r in rows:
        loads[r["step_group"]] += r["length"]
        members[r["step_group"]].add(r["sequence_id"])
    assert len(loads) > 5 and max(loads.values()) - min(loads.values()) <= 2048
    flat = [s for g in sorted(members) for s in sorted(members[g])]
    assert flat == sorted(flat)


def test_dealt_is_even():
    sizes = [2048] * 37 + [1024] * 5 + [512] * 11 + [256] * 3 + [1]
    groups = packing.dealt(sizes, 8 * 2048)
    loads = [sum(s for s, g in zip(sizes, groups) if g == k) for k in range(max(groups) + 1)]
    assert max(loads) - min(loads) <= 1024 and packing.dealt([], 10) == []


def test_repeated_null_ids_and_order(spark, whole):
    rows = [(None, "a b"), (None, "c"), (3, "same"), (3, "same"), (4, None)]
    out = rows_of(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1))
    assert sum(r["length"] for r in out) == sum(len(whole(t)) for _, t in rows)
    again = rows_of(spark.createDataFrame(rows[::-1], "doc_id bigint, text string").coalesce(1))
    assert out == again


def test_sequence_ids_are_of_one_task(spark):
    df = spark.createDataFrame([(i, prose(i, 50)) for i in range(40)], "doc_id bigint, text string").repartition(6)
    rows = rows_of(df)
    check(rows, {r["id"]: [x for q in sorted((q for q in rows if q["id"] == r["id"]), key=lambda q: q["start"]) for x in ids_of(q)] for r in rows})


def test_clashing_columns_and_empty(spark, clashing, awkward, whole, empty):
    more = clashing.select("*", *[F.lit("mine").alias(c) for c in ("start", "ids", "context", "name")])
    check(rows_of(more), {i: whole(t) for i, t in awkward})
    assert rows_of(empty) == []


def test_ids_of_parts_are_those_of_the_whole(whole, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 40)
    with open(PATH, encoding="utf-8") as f:
        tokens = packing.Tokens(f.read())
    assert tokens.fast is not None
    rng = random.Random(3)
    for alphabet in ("abcXY 's't 12.,!?。、漢字Aéñ\n\t  '’-|", "abcé漢。、,.'s1", "ab  \n'", "a"):
        for _ in range(150):
            text = "".join(rng.choice(alphabet) if rng.random() < 0.98 else "<|endoftext|>" for _ in range(rng.randint(0, 600)))
            assert array("I", tokens.ids(text)).tolist() == whole(text)[:-1]


def test_every_character(whole):
    with open(PATH, encoding="utf-8") as f:
        tokens = packing.Tokens(f.read())
    for c in [*range(1, 0x3100), *range(0xA000, 0xA100), *range(0xF900, 0x10800, 7)]:
        text = f"x{chr(c)}{chr(c)} {chr(c)}y {chr(c)} 1{chr(c)}2 {chr(c)}\n{chr(c)}"
        assert array("I", tokens.ids(text)).tolist() == whole(text)[:-1], hex(c)


def test_other_vocabularies_go_to_the_tokenizer_itself():
    other = public_tokenizers.path("word_bpe_49k.json")
    with open(other, encoding="utf-8") as f:
        tokens = packing.Tokens(f.read())
    assert tokens.fast is None
    want = Tokenizer.from_file(other).encode("Some Words, here", add_special_tokens=False).ids
    assert array("I", tokens.ids("Some Words, here")).tolist() == want


def test_query_checksums(spark, tmp_path, whole):
    texts = [(i, prose(i, 700)) for i in range(8)] + [(9, None)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    text = dict(texts)
    for r in queries.op13_packing(spark, str(tmp_path)).collect():
        ids = whole(text[r.doc_id])[r.start : r.start + r.length]
        assert zlib.crc32(array("I", ids).tobytes()) == r.ids_crc32
