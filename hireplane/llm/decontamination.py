"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are lower-cased word sequences; all go into one suffix automaton over
word numbers. Document words are streamed through it, and the longest suffix
that some item contains is tracked. Where it reaches ``WINDOW`` words (or a whole item
that is shorter) the words of that window are hit, and the state tells which
items hold it. Only stretches whose neighbouring words are neighbours in some
item are streamed; all other words leave the automaton at its start anyway.

The automaton of a block of items is broadcast; a block holds at most
``BLOCK_CHARS`` characters, and more items make more blocks, whose hits are
united per document.

Null and empty texts have no words, and are not contaminated. Null items and
items without words match nothing; repeated items all count, null item ids are
left out. Repeated documents are separate rows. Only id and text are read,
other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hireplane.llm import batches as B

WINDOW = 13
BLOCK_CHARS = 4_000_000
#: A document is contaminated when at least this share of its words is hit: one in 20.
COVERAGE = 20


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first) of the lower-case words of a run of texts."""
    low = B.LOWER[data]
    starts, ends, first = B.word_spans(low, offsets, B.ALNUM)
    return B.word_hashes(low, starts, ends), starts, ends, first


class Automaton:
    """Generalised suffix automaton over the word numbers of a block of items."""

    def __init__(self, ids: list[str], texts: list[str], window: int = WINDOW):
        self.window = window
        hashes, _, _, first = words_of(*B.flat(pa.array(texts, pa.large_string())))
        self.vocabulary = np.unique(hashes)
        numbers = np.searchsorted(self.vocabulary, hashes)
        items = [numbers[first[i] : first[i + 1]] for i in range(len(texts))]
        pairs = [a[:-1].astype(np.int64) * len(self.vocabulary) + a[1:] for a in items if len(a) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.ids = ids
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for item in items:
            last = 0
            for word in item.tolist():
                last = self._extend(last, word)
        self.shortest = min([window, *(len(item) for item in items if len(item))], default=window)
        self._mark(items)

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of ``q`` for the shorter suffixes that end in it after ``p``."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def _mark(self, items: list[np.ndarray]) -> None:
        """Which items pass through the states of ``window`` words, and where short items end."""
        self.holders: dict[int, set[int]] = {}
        self.whole: dict[int, tuple[int, set[int]]] = {}
        for number, item in enumerate(items):
            state = 0
            for i, word in enumerate(item.tolist()):
                state = self.next[state][word]
                if i + 1 >= self.window:
                    self.holders.setdefault(self.ancestor(state), set()).add(number)
            if 0 < len(item) < self.window:
                self.whole.setdefault(state, (len(item), set()))[1].add(number)

    def ancestor(self, state: int) -> int:
        """The state of the last ``window`` words of what ended in ``state``."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers, -1 for words of no item."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def stretches(self, numbers: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """Word ranges in which every neighbouring pair is one of an item, long enough to hold a window."""
        if not len(numbers):
            return []
        known = numbers >= 0
        pair = numbers[:-1].astype(np.int64) * len(self.vocabulary) + numbers[1:]
        at = np.minimum(np.searchsorted(self.pairs, pair), max(0, len(self.pairs) - 1))
        joined = known[:-1] & known[1:] & (self.pairs[at] == pair if len(self.pairs) else False)
        cuts = first[1:-1]
        joined[cuts[(cuts > 0) & (cuts < len(numbers))] - 1] = False
        breaks = np.flatnonzero(~joined) + 1
        begin, end = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(numbers)]])
        keep = (end - begin >= self.shortest) & known[begin]
        return list(zip(begin[keep].tolist(), end[keep].tolist()))

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit ranges of one stretch, and the numbers of the items that hold them."""
        state = matched = 0
        ranges: list[tuple[int, int]] = []
        seen: set[int] = set()
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            if matched >= self.window:
                ranges.append((i + 1 - self.window, i + 1))
                seen.add(self.ancestor(state))
            if self.whole:
                s = state
                while s > 0:
                    length, items = self.whole.get(s, (0, ()))
                    if length and (length <= matched):
                        ranges.append((i + 1 - length, i + 1))
                        seen.update(-1 - n for n in items)
                    s = self.link[s]
        found: set[int] = set()
        for mark in seen:
            found |= {-1 - mark} if mark < 0 else self.holders.get(mark, set())
        return ranges, found


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


HITS = "n_words bigint, spans array<struct<start:int,stop:int>>, bytes array<struct<start:int,stop:int>>, items array<string>"


def _scan(docs: DataFrame, automaton: Automaton) -> DataFrame:
    """id, words, hit word ranges, the same as byte ranges, item ids; one pass without shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    kind = docs.schema["id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = shared.value
        for piece in B.pieces(batches, "text"):
            data, offsets = B.flat(B.strings(piece.column("text")))
            hashes, starts, ends, first = words_of(data, offsets)
            numbers = auto.numbers(hashes)
            hit: dict[int, tuple[list, set]] = {}
            for begin, end in auto.stretches(numbers, first):
                ranges, found = auto.stream(numbers[begin:end].tolist())
                if ranges:
                    doc = int(np.searchsorted(first, begin, side="right")) - 1
                    spans, items = hit.setdefault(doc, ([], set()))
                    spans += [(begin + a, begin + b) for a, b in ranges]
                    items |= found
            spans, places, items = [], [], []
            for doc in range(piece.num_rows):
                ranges, found = hit.get(doc, ([], ()))
                ranges = _merged(ranges)
                spans.append([{"start": a - int(first[doc]), "stop": b - int(first[doc])} for a, b in ranges])
                places.append([{"start": int(starts[a] - offsets[doc]), "stop": int(ends[b - 1] - offsets[doc])} for a, b in ranges])
                items.append(sorted({auto.ids[n] for n in found if auto.ids[n] is not None}))
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), pa.array(np.diff(first), pa.int64()), pa.array(spans, span), pa.array(places, span), pa.array(items, pa.list_(pa.string()))],
                names=["id", "n_words", "spans", "bytes", "items"],
            )

    return docs.mapInArrow(run, f"id {kind}, {HITS}")


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, window: int = WINDOW) -> Iterator[Automaton]:
    """Automata of blocks of items; the driver holds one block of bounded size at a time."""
    rows = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string"), text_col).toLocalIterator()
    ids: list[str] = []
    texts: list[str] = []
    for item_id, text in rows:
        if texts and sum(map(len, texts)) + len(text) > block_chars:
            yield Automaton(ids, texts, window)
            ids, texts = [], []
        ids.append(item_id)
        texts.append(text)
    yield Automaton(ids, texts, window)


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document: id, n_words, n_hit, spans (word ranges), bytes (byte ranges), items, contaminated.

    With several blocks the id has to be unique, as their hits are united by it.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = [_scan(rows, automaton) for automaton in blocks(items, item_id, "text", block_chars, window)]
    out = found[0]
    if len(found) > 1:
        for part in found[1:]:
            out = out.unionAll(part)
        union = lambda name: F.flatten(F.collect_list(name)).alias(name)
        out = out.groupBy("id").agg(F.max("n_words").alias("n_words"), union("spans"), union("bytes"), union("items"))
        out = out.select("id", "n_words", _united("spans"), _united("bytes"), F.array_sort(F.array_distinct("items")).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    out = out.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (COVERAGE * F.col("n_hit") >= F.col("n_words")))
    return out.withColumnRenamed("id", id_col)


def _united(name: str):
    """Overlapping ranges of several blocks made one."""
    kind = "array<struct<start:int,stop:int>>"
    step = lambda acc, s: F.when(
        (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["stop"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], s["stop"]).alias("stop")))),
    ).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(F.sort_array(name), F.array().cast(kind), step).alias(name)


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with their columns.

    A document whose hit words exceed the coverage limit goes as a whole; what
    is below the limit is no contamination and its text stays as it is. Hits
    and texts meet by id and a hash of the text, so rows that share an id, or
    have none, are judged each by its own text.
    """
    digest = F.xxhash64(docs[text_col])
    rows = docs.select(F.struct(docs[id_col].alias("id"), digest.alias("digest")).alias("key"), docs[text_col].alias("text"))
    bad = hits(rows, items, "key", "text", item_id, window).where("contaminated")
    bad = bad.select(F.col("key")["id"].alias("_id"), F.col("key")["digest"].alias("_digest"))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_id"]) & (digest == bad["_digest"]), "left_anti")


def cut(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """The documents with every hit span cut out of the text, and ``n_hit``; ids have to be unique."""
    found = hits(docs, items, id_col, text_col, item_id, window).where("n_hit > 0").select(F.col(id_col).alias("_id"), "bytes", F.col("n_hit").alias("_n_hit"))
    data, spans = F.encode(docs[text_col], "utf-8"), found["bytes"]
    stops = F.transform(spans, lambda s: s["stop"])
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(data)))
    pieces = F.zip_with(F.concat(F.array(F.lit(0)), stops), starts, lambda a, b: F.decode(F.substring(data, a + 1, b - a), "utf-8"))
    joined = docs.join(found, docs[id_col].eqNullSafe(found["_id"]), "left")
    rest = F.when(spans.isNull(), docs[text_col]).otherwise(F.array_join(pieces, ""))
    return joined.select(*[rest.alias(c) if c == text_col else docs[c] for c in docs.columns], F.coalesce(found["_n_hit"], F.lit(0)).alias("n_hit"))
