"""Which of very many terms a text contains, by an index of the terms' first characters.

A term is filed under its first characters, as many as the longest of
``KEY_LENGTHS`` that it has, half of it or more up to twice the last. A text is read once:
every place gives a short window of the text, cut from there, and the window's
beginnings are looked up in the index, which is broadcast in blocks of a bounded
number of terms. What meets a key is verified by comparing the whole term with
the window. The cost per character does not grow with the number of terms, and
neither texts nor windows are shuffled.

Terms are compared as they are; lower both sides first to ignore case. Null and
repeated terms are dropped, a null text is empty, the empty term is in every
text. Ids may repeat: a pair of id and term comes once.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hireplane.functions import text

KEY_LENGTHS = (1, 2, 3, 4, 8, 16, 32)
#: Terms up to this length are found by window; longer ones are searched one by one.
MOST_WINDOW = 96
#: Terms per broadcast: at most about 150 MB.
TERMS_PER_BLOCK = 500_000
LONG_TERMS_PER_SCAN = 2000


def key_length(term: Column) -> Column:
    length = F.length(term)
    return reduce(lambda out, n: F.when(length >= n, n).otherwise(out), KEY_LENGTHS[1:], F.lit(KEY_LENGTHS[0]))


def windows(body: Column, width: int) -> Column:
    """What stands at every place of a text, up to ``width`` characters."""
    # A place inside a surrogate pair is no place.
    return F.regexp_extract_all(body, F.lit(rf"(?s)(?![\uDC00-\uDFFF])(?=(.{{1,{width}}}))"), F.lit(1))


def term_index(terms: DataFrame, term_col: str = "term") -> DataFrame:
    """``key`` and ``term`` of the distinct terms that a window can hold."""
    term = F.col(term_col)
    rows = terms.select(term.alias("term")).where(F.length(term).between(1, MOST_WINDOW)).distinct()
    return rows.select(F.left("term", key_length(F.col("term"))).alias("key"), "term")


def _by_window(texts: DataFrame, index: DataFrame, lengths: list[int], width: int) -> DataFrame:
    at = texts.select("id", F.explode(windows(F.col("body"), width)).alias("window"))
    # At the end of a text keys of several lengths are the same; pairs are made distinct in the end.
    keys = F.array(*[F.left("window", F.lit(n)) for n in lengths])
    return (
        at.select("id", "window", F.explode(keys).alias("key"))
        .join(F.broadcast(index), "key")
        .where(F.startswith("window", F.col("term")))
        .select("id", "term")
    )


def scanned(texts: DataFrame, terms: DataFrame, n_terms: int, per_scan: int = LONG_TERMS_PER_SCAN) -> DataFrame:
    """(id, term) pairs by searching the terms one by one, ``per_scan`` of them in each pass over the texts."""
    chunks, parts = max(1, math.ceil(n_terms / per_scan)), []
    for k in range(chunks):
        mine = terms if chunks == 1 else terms.where(F.pmod(F.xxhash64("term"), F.lit(chunks)) == k)
        wanted = mine.agg(F.collect_set("term")).scalar()
        found = text.bind(F.col("body"), lambda body: F.filter("wanted", lambda t: F.contains(body, t)))
        parts.append(texts.select("id", "body", wanted.alias("wanted")).select("id", F.explode(found).alias("term")))
    return reduce(DataFrame.unionAll, parts)


def contained_terms(
    texts: DataFrame, terms: DataFrame, id_col: str = "id", text_col: str = "text", term_col: str = "term",
    per_block: int = TERMS_PER_BLOCK,
) -> DataFrame:
    """The distinct pairs of ``id`` and ``term`` with the term in the id's text.

    One pass over the texts for each ``per_block`` terms.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    texts = texts.select(F.col(id_col).alias("id"), body.alias("body"))
    index = term_index(terms, term_col)
    size = index.agg(
        F.count("*").alias("n"), F.max(F.length("term")).alias("width"), F.collect_set(F.length("key")).alias("lengths"),
    ).first()
    parts = []
    blocks = math.ceil(size.n / per_block)
    for k in range(blocks):
        block = index if blocks == 1 else index.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k)
        parts.append(_by_window(texts, block, sorted(size.lengths), size.width))
    rest = terms.select(F.col(term_col).alias("term")).where(~F.length("term").between(1, MOST_WINDOW)).distinct()
    if n_rest := rest.count():
        parts.append(scanned(texts, rest, n_rest))
    if not parts:
        return texts.select("id", F.lit("").alias("term")).where(F.lit(False))
    return reduce(DataFrame.unionAll, parts).distinct()
