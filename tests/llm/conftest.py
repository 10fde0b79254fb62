import pytest
from brute import prose

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def awkward():
    """Documents with nulls, empty and long texts, ties, repeated passages and odd characters: (doc_id, text)."""
    shared, long_text = prose(1, 70), prose(2, 6000)
    rows = [
        (5, prose(3, 80)), (2, prose(3, 80)), (9, None), (7, ""), (8, " \t\n "), (1, "one"), (3, "two words"),
        (10, prose(4, 30) + "\n" + shared + " " + prose(5, 40)), (11, prose(6, 20) + " " + shared), (4, shared + "  " + prose(7, 90)),
        (12, long_text), (6, prose(8, 10) + " " + long_text[2000:9000]), (13, "Ünïcödé ñandú 漢字 テスト " * 20), (14, "x " * 300),
        (15, "x " * 200), (16, prose(3, 79) + " other"), (17, prose(9, 49)), (18, prose(9, 49)), (19, prose(10, 50)), (20, prose(10, 50)),
        (21, "A!! B!! C!! " * 40), (22, "\n".join(["same line here"] * 30)), (23, "a b c a b c d\x0be\x0cf\x1cg"),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, awkward):
    langs = ["en", "de", None]
    rows = [(i, t, langs[i % 3], None if i % 4 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in awkward]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with extra columns named like results and helpers."""
    from pyspark.sql import functions as F

    names = ["n_words", "score", "id", "spans", "fp", "component_id", "copy", "shuffle_key", "_count", "kept", "x", "rest", "least", "failed"]
    return docs.select("*", *[F.lit("mine").alias(n) for n in names])
