"""Substring dedup by compaction of a sparse De Bruijn graph of token k-mers.

Nodes are the k-mers of ``NODE`` words with the least hash among ``SPAN``
neighbouring ones; an edge is a longer k-mer, the words from one such node to
the end of the next. As ``NODE + 2 * SPAN = WINDOW`` the spans inside a window
of 50 words choose at least two nodes, so it holds an edge, and equal windows
hold equal edges.

An aggregation by edge finds those of several documents, and whether they have
one successor and one predecessor only. Joined back to their places, edges that
follow each other without a branch compact into paths. All occurrences of a path
are alike from end to end, so what holds a path holds all its windows. Spans are
verified at their source coordinates, by 128 bits of hash of their words joined
over all documents: each path of 50 words or more as a whole, and each window of
50 words that crosses a branch or sticks out of a path but holds repeated edges
only. Edges only say which spans are verified; none goes by them alone.

An edge that very many documents share has one row in the aggregation, and its
places meet that row in a join of two plain shuffles, which adaptive execution
splits where a key is crowded.

A word goes if some window over it also starts in a document with a smaller id.
Null texts and texts of fewer than 50 words lose nothing. Documents with a null
id lose nothing and are no source. Rows that repeat an id must be equal; they
are judged alike, and never by each other. Only id and text are read beside
the columns handed through, which may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hireplane.llm import batches as B

WINDOW = 50
NODE, SPAN = 10, 20


class Words:
    """Words of one piece of texts, with the edges of their sparse graph."""

    def __init__(self, texts: pa.Array):
        self.data, offsets = B.flat(texts)
        self.starts, self.ends, self.first = B.word_spans(self.data, offsets, B.SPACED)
        self.hashes = B.word_hashes(self.data, self.starts, self.ends)
        self.prefix = B.WORDS.prefix(self.hashes)

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text number, first word, end) of all edges, by place; and the node that the span at each word chooses."""
        n = len(self.hashes) - NODE + 1
        sizes = np.diff(self.first)
        if n < SPAN:
            return (np.zeros(0, np.int64),) * 4
        at = np.arange(n)
        node = B.WORDS.ranges(self.prefix, at, at + NODE)
        least = np.lib.stride_tricks.sliding_window_view(node, SPAN).argmin(1)
        text = np.repeat(np.arange(len(sizes)), sizes)
        reach = NODE + SPAN - 1
        inside = np.flatnonzero((text[: len(least)] == text[reach - 1 : reach - 1 + len(least)]) & (sizes[text[: len(least)]] >= WINDOW))
        chosen = np.unique(inside + least[inside])
        same = text[chosen[:-1]] == text[chosen[1:]]
        begin, end = chosen[:-1][same], chosen[1:][same] + NODE
        return text[begin], begin, end, np.arange(len(least)) + least


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def graph_edges(docs: DataFrame) -> DataFrame:
    """id, pos, size, edge, next and previous edge (their low halves) of every edge of every document."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in B.pieces(batches, "text"):
            words = Words(B.strings(piece.column("text")))
            text, begin, end, _ = words.edges()
            edge = B.WORDS.ranges(words.prefix, begin, end)
            low = (edge & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            after, before = np.zeros_like(low), np.zeros_like(low)
            joined = text[:-1] == text[1:]
            after[:-1][joined], before[1:][joined] = low[1:][joined], low[:-1][joined]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("id").take(pa.array(text)), pa.array((begin - words.first[text]).astype(np.int32)),
                    pa.array((end - begin).astype(np.int32)), _long(edge), pa.array(after), pa.array(before),
                ],
                names=["id", "pos", "size", "edge", "after", "before"],
            )

    return docs.mapInArrow(run, f"id {kind}, pos int, size int, edge bigint, after int, before int")


def paths(docs: DataFrame) -> DataFrame:
    """id, start, stop (words): compacted runs of edges that several documents hold."""
    edges = graph_edges(docs)
    found = edges.groupBy("edge").agg(
        F.min("id").alias("least"), F.max("id").alias("most"),
        F.min("after").alias("a0"), F.max("after").alias("a1"), F.min("before").alias("b0"), F.max("before").alias("b1"),
    ).where("least < most")
    # Joined by another form of the edge: the aggregation and the join are then two stages, and the join alone can be split.
    key = F.bitwise_not("edge").alias("key")
    repeated = found.select(key, F.expr("a0 = a1").alias("one_after"), F.expr("b0 = b1").alias("one_before"))
    places = edges.select(key, "id", "pos", "size").join(repeated, "key")
    by_doc = Window.partitionBy("id").orderBy("pos", "size")
    follows = (F.lag(F.col("pos") + F.col("size") - NODE).over(by_doc) == F.col("pos")) & F.lag("one_after").over(by_doc) & F.col("one_before")
    runs = places.withColumn("_new", F.when(follows, 0).otherwise(1)).withColumn("path", F.sum("_new").over(by_doc))
    return runs.groupBy("id", "path").agg(
        F.min("pos").alias("start"), F.max(F.col("pos") + F.col("size")).alias("stop"),
    ).select("id", "start", "stop")


def _spans(pairs: DataFrame) -> DataFrame:
    """id, start, stop and two hashes of the paths of a window or more, and of the windows that hold repeated edges only and are inside no path."""
    kind = pairs.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in B.pieces(batches, "text"):
            words = Words(B.strings(piece.column("text")))
            second = B.WORDS2.prefix(words.hashes)
            text, begin, end, choice = words.edges()
            edge_first = np.searchsorted(text, np.arange(piece.num_rows + 1))
            owners, places, stops = [], [], []
            for i, spans in enumerate(piece.column("paths")):
                if not spans.is_valid:
                    continue
                base, n = words.first[i], words.first[i + 1] - words.first[i]
                if n < WINDOW:
                    continue
                start, stop = _ends(spans)
                b, e = begin[edge_first[i] : edge_first[i + 1]] - base, end[edge_first[i] : edge_first[i + 1]] - base
                run_of = np.searchsorted(start, b, side="right") - 1
                unknown = np.concatenate([[0], np.cumsum((run_of < 0) | (e > stop[run_of]))])
                at = np.arange(n - WINDOW + 1)
                # The nodes that spans inside a window choose are the same wherever its words stand.
                low = np.searchsorted(b, choice[base + at] - base)
                high = np.searchsorted(e - NODE, choice[base + at + WINDOW - NODE + 1 - SPAN] - base, side="right")
                path = np.searchsorted(start, at, side="right") - 1
                closed = (path >= 0) & (at + WINDOW <= stop[path])
                at = at[(unknown[high] == unknown[low]) & (high > low) & ~closed]
                whole = stop - start >= WINDOW
                owners.append(np.full(len(at) + whole.sum(), i))
                places += [at, start[whole]]
                stops += [at + WINDOW, stop[whole]]
            owner, at, end_at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owners, places, stops))
            base = words.first[owner]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("id").take(pa.array(owner)), pa.array(at.astype(np.int32)), pa.array(end_at.astype(np.int32)),
                    _long(B.WORDS.ranges(words.prefix, base + at, base + end_at)), _long(B.WORDS2.ranges(second, base + at, base + end_at)),
                ],
                names=["id", "start", "stop", "h1", "h2"],
            )

    return pairs.mapInArrow(run, f"id {kind}, start int, stop int, h1 bigint, h2 bigint")


def _ends(spans: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of a list of spans, by start."""
    values = spans.values
    if values is None or not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, stop = (np.asarray(values.field(k)).astype(np.int64) for k in (0, 1))
    order = np.argsort(start, kind="stable")
    return start[order], stop[order]


def removals(rows: DataFrame) -> DataFrame:
    """id and spans (start, stop in words) to remove, of all documents that lose words."""
    runs = paths(rows.select("id", "text").where("id IS NOT NULL"))
    lists = runs.groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("paths"))
    # A left join, so that the texts are shuffled once for this join and the caller's.
    spans = _spans(rows.join(lists, "id", "left"))
    least = spans.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    key = F.bitwise_not("h1").alias("key")  # as in ``paths``
    verified = spans.select("id", "start", "stop", key, "h2").join(least.select(key, "h2", "least"), ["key", "h2"]).where("least < id")
    return verified.groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _kept_words(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words, removed words, and the kept words with single blanks between, of each text."""
    data, offsets = B.flat(B.strings(piece.column("text")))
    starts, ends, first = B.word_spans(data, offsets, B.SPACED)
    sizes = np.diff(first)
    change = np.zeros(len(starts) + 1, np.int64)
    for i, spans in enumerate(piece.column("spans")):
        if spans.is_valid:
            start, stop = _ends(spans)
            np.add.at(change, first[i] + np.minimum(start, sizes[i]), 1)
            np.add.at(change, first[i] + np.minimum(stop, sizes[i]), -1)
    gone = np.cumsum(change[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(gone)])
    # Every kept word is followed by one blank.
    size = np.where(gone, 0, ends - starts + 1)
    place = np.concatenate([[0], np.cumsum(size)])
    source = np.repeat(starts - place[:-1], size) + np.arange(place[-1])
    blank = np.zeros(place[-1], bool)
    blank[place[1:][~gone] - 1] = True
    source[blank] = 0
    raw = np.where(blank, np.uint8(0x20), data[source] if len(data) else np.zeros(0, np.uint8)).astype(np.uint8).tobytes()
    kept = [raw[place[a] : max(place[a], place[b] - 1)].decode() for a, b in zip(first[:-1], first[1:])]
    return sizes, total[first[1:]] - total[first[:-1]], kept


def _cut(rows: DataFrame, keep_untouched: bool) -> DataFrame:
    """``rows`` (with ``spans``) with the text replaced by its kept words, and n_words and n_removed.

    ``keep_untouched``: texts that lose nothing stay as they are.
    """
    columns = [c for c in rows.columns if c != "spans"]
    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in B.pieces(batches, "text"):
            sizes, removed, kept = _kept_words(piece)
            if keep_untouched:
                kept = [t if n == 0 else k for t, n, k in zip(piece.column("text").to_pylist(), removed, kept)]
            arrays = [pa.array(kept, pa.string()) if c == "text" else piece.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())], names=[*columns, "n_words", "n_removed"])

    return rows.mapInArrow(run, ", ".join([*fields, "n_words bigint", "n_removed bigint"]))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, n_removed, ``kept`` (its kept words joined by one blank)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = _cut(rows.join(removals(rows), "id", "left"), keep_untouched=False)
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("text").alias("kept"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents with repeated passages removed from the text, with their columns.

    Texts that lose nothing stay as they are; others are their kept words with
    single blanks between (empty if none). ``chars_col``, where there is one, is then counted anew.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rest = F.struct(*[F.col(c) for c in others]) if others else F.struct(F.lit(0).alias("none"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), rest.alias("rest"))
    out = _cut(rows.join(removals(rows), "id", "left"), keep_untouched=True)

    def column(c: str):
        if c in (id_col, text_col):
            return F.col("id" if c == id_col else "text").alias(c)
        if c == chars_col:
            return F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col("rest").getField(c)).alias(c)
        return F.col("rest").getField(c).alias(c)

    return out.select(*[column(c) for c in docs.columns])
