"""Fill-in-the-middle against a plain version that holds whole texts."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from hireplane.llm import fill_in_middle as fim

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)


def plain(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output)."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def wanted(rows):
    out = []
    for i, t in rows:
        *head, output = plain(i, t)
        out.append((i, *head, sha(output), sha(t or "")))
    return sorted(out, key=str)


def got(df, **options):
    done = fim.digests(fim.output_pieces(df, **options))
    columns = ["id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    return sorted([tuple(r) for r in done.select(columns).collect()], key=str)


def odd_texts():
    rng = random.Random(5)
    alphabet = "aZ  é漢\n\t1<>PSM𝒳.\x00"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    return [*made, "has <P> inside", "has <S>", "<M>", "<P", "a" * 500, "x y " * 4000, "é" * 3000]


def test_equals_plain_version(spark, awkward):
    rows = [*awkward, *[(1000 + i, t) for i, t in enumerate(odd_texts())]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for chunk in (1, 7, fim.CHUNK_UNITS):
        assert got(df, chunk=chunk) == wanted(rows)


def test_forms_all_occur_and_texts_come_back(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts() * 2)]
    pieces = fim.output_pieces(spark.createDataFrame(rows, "doc_id bigint, text string"), chunk=5)
    heads = {r.row: r for r in pieces.where("place = 0").collect()}
    assert {r.form for r in heads.values()} == {"plain", "psm", "spm"}
    texts = fim.output_texts(pieces).collect()
    assert len(texts) == len(rows)
    for r in texts:
        head = heads[r.row]
        assert r.output == plain(*rows[head.id])[4]
        assert fim.restored(r.output, head.form) == rows[head.id][1]


def test_pieces_are_bounded_and_in_order(spark):
    pieces = fim.output_pieces(spark.createDataFrame([(4, "ab, " * 5000)], "doc_id bigint, text string"), chunk=64)
    rows = pieces.select("place", F.octet_length("piece").alias("size")).collect()
    assert [r.place for r in rows] == list(range(len(rows)))
    assert max(r.size for r in rows) <= 2 * 64


def test_repeated_null_and_text_ids(spark):
    rows = [(None, "one text"), (None, "another text"), (None, None), ("a", "same"), ("a", "same"), ("b", "")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert got(df) == wanted(rows)


def test_clashing_columns(spark, clashing, awkward):
    more = clashing.select("*", *[F.lit("mine").alias(c) for c in ("row", "place", "piece", "n", "form", "name")])
    assert got(more) == wanted(awkward)


def test_empty(empty):
    assert got(empty) == []


def test_one_shuffle_of_the_texts(docs):
    plan = fim.digests(fim.output_pieces(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and "hashpartitioning" in plan
