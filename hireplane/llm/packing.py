"""Hierarchical packing of tokenised documents into sequences of several context sizes.

A task reads its documents, turns each into token ids with an end id, and packs
them block by block (``block`` ids at a time), so its memory is bounded and no
id is ever shuffled:

1. routing: whole windows of the largest size are cut off a long document and
   are sequences at once; what is left goes to the smallest tier (context size)
   that holds it;
2. tiers are packed from the largest down: a window opens with a piece of its
   tier, its gap is filled with the longest pieces of shorter tiers that fit, and
   if none fits a piece is cut to close the gap, so a window is always full;
3. pieces that no longer fill a window wait for the next block. After the last
   one they are cut to powers of two, so nothing is padded at all if the tiers
   are powers of two;
4. the block's sequences are dealt to step groups of about ``step`` ids each,
   the longest first and each to the group with the least so far, so all steps
   of a block cost the same and mix the sizes alike.

Documents that share a sequence come from one partition of the input; shuffle
the documents first (mixing does) where neighbours in the files are alike. A
partition is packed in the order of id and text, so a task that runs again
after a lost executor gives the same sequences.

Texts of over ``STRETCH`` characters are tokenised part by part. They are cut
before white space that follows other characters, where a byte-level vocabulary
always cuts, so the ids are those of the whole text. A long run without white
space is cut between a letter and a following mark; one of letters alone goes
to the tokeniser whole.

Null texts count as empty: such a document is its end id. Rows that repeat an id
or repeat as a whole are documents of their own; a null id stays null. Other
columns are not looked at. An empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from hireplane.llm.batches import pieces
from hireplane.llm.rowkeys import kind_of, settled

TIERS = (2048, 1024, 512, 256)
END_ID = 1
BLOCK_IDS = 1 << 21
STEP_IDS = 64 * 2048
ROWS_PER_BATCH = 512
#: Ids of one task's sequences and step groups start at its number times this.
PER_TASK = 33

# --- fixed values: how byte-level vocabularies split a text, and white space as they read it
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = r"\t-\r \x85\xa0  -     　"
# --- marks that end a run of letters there: not the apostrophe, nor the bar that special tokens hold
MARKS = r"!-&(-@\[-`{}~、-〃〈-】！-／：-＠"

_CUT = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
_LETTER_MARK = regex.compile(rf"(?<=\p{{L}})(?=[{MARKS}])")
STRETCH = 1 << 20


def byte_chars() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 as it is, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def merge_ranks(spec: dict) -> dict[bytes, int] | None:
    """Byte strings to ids of a byte-level vocabulary whose ids follow the order of its merges; None for another kind."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))
    level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    if not plain or not level or spec.get("normalizer") or len(model["vocab"]) != 256 + len(model["merges"]):
        return None
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != list(range(256, 256 + len(merged))):
        return None
    chars = byte_chars()
    return {bytes(chars[c] for c in token): i for token, i in model["vocab"].items()}


class Tokens:
    """Ids of texts as little-endian unsigned 32-bit numbers.

    The ids are those of the tokenizer file, read by ``tokenizers``. A byte-level
    vocabulary also goes to ``tiktoken``, which gives the same ids several times
    as fast; texts that hold a special token, and other vocabularies, do not.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = merge_ranks(json.loads(vocabulary))
        self.fast = ranks and tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _encoded(self, text: str) -> bytes:
        if self.fast is None or any(t in text for t in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast(text)).tobytes()

    def _unbroken(self, text: str) -> Iterator[bytes]:
        """A long run without white space, cut where a letter is followed by a mark."""
        start = 0
        while start < len(text):
            cut = _LETTER_MARK.search(text, start + STRETCH)
            end = cut.start() if cut else len(text)
            yield self._encoded(text[start:end])
            start = end

    def ids(self, text: str) -> bytes:
        out, start = [], 0
        while len(text) - start > STRETCH:
            cut = _CUT.search(text, start + STRETCH)
            end = cut.start() if cut else len(text)
            out += self._unbroken(text[start:end]) if end - start > 2 * STRETCH else [self._encoded(text[start:end])]
            start = end
        return b"".join([*out, self._encoded(text[start:])])


_LOADED: dict[str, Tokens] = {}


def loaded(vocabulary: str) -> Tokens:
    """The tokenizer of this Python worker, kept from task to task."""
    if vocabulary not in _LOADED:
        _LOADED.clear()
        _LOADED[vocabulary] = Tokens(vocabulary)
    return _LOADED[vocabulary]


class _Store:
    """Pieces (document, start, length) by length, with the longest up to a limit at hand."""

    def __init__(self, most: int):
        self.by_length: list[list] = [[] for _ in range(most + 1)]
        self.filled = 0  # bit n: there is a piece of length n
        self.total, self.most = 0, most

    def put(self, document: int, start: int, length: int) -> None:
        self.by_length[length].append((document, start, length))
        self.filled |= 1 << length
        self.total += length

    def longest(self, limit: int) -> int:
        """Length of the longest piece of at most ``limit`` ids, 0 if there is none."""
        return max(0, (self.filled & ((1 << (limit + 1)) - 1)).bit_length() - 1)

    def take(self, length: int) -> tuple[int, int, int]:
        stack = self.by_length[length]
        piece = stack.pop()
        if not stack:
            self.filled &= ~(1 << length)
        self.total -= length
        return piece

    def fill(self, window: list, gap: int) -> None:
        """Close ``gap``: the longest that fit, then a cut of the longest of all. The store must hold enough."""
        while gap:
            if length := self.longest(gap):
                window.append(self.take(length))
                gap -= length
            else:
                document, start, length = self.take(self.longest(self.most))
                window.append((document, start, gap))
                self.put(document, start + gap, length - gap)
                gap = 0


def tail_sizes(tiers: tuple[int, ...]) -> list[int]:
    """The tiers and, below the smallest, the powers of two."""
    return sorted({*tiers, *(1 << k for k in range(tiers[-1].bit_length()) if 1 << k < tiers[-1])}, reverse=True)


class Packer:
    """Packs blocks of documents; ``add`` and ``finish`` return sequences (context size, pieces)."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tuple(sorted(set(tiers), reverse=True))
        self.store = _Store(self.tiers[0])
        self.ready: list[tuple[int, list]] = []

    def route(self, document: int, length: int) -> None:
        top = self.tiers[0]
        whole = length - length % top
        self.ready.extend((top, [(document, start, top)]) for start in range(0, whole, top))
        if length > whole:
            self.store.put(document, whole, length - whole)

    def pack(self) -> list[tuple[int, list]]:
        """All windows that can be filled now, tier by tier from the largest."""
        store = self.store
        for size, shorter in zip(self.tiers, (*self.tiers[1:], 0)):
            while store.total >= size and (length := store.longest(size)) > shorter:
                window = [store.take(length)]
                store.fill(window, size - length)
                self.ready.append((size, window))
        done, self.ready = self.ready, []
        return done

    def finish(self) -> list[tuple[int, list]]:
        """What is left, cut to the sizes down to 1."""
        out = self.pack()
        for size in tail_sizes(self.tiers):
            while self.store.total >= size:
                window: list = []
                self.store.fill(window, size)
                out.append((size, window))
        return out


def dealt(sizes: list[int], step: int) -> list[int]:
    """A step group for each size: longest first, each to the group that has the least."""
    groups = max(1, round(sum(sizes) / step))
    loads = [(0, g) for g in range(groups)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = loads[0]
        out[i] = g
        heapq.heapreplace(loads, (load + sizes[i], g))
    return out


class _Writer:
    """Sequences as rows: one per piece, numbered within the task, step group by step group."""

    def __init__(self, step: int, schema: pa.Schema):
        self.step, self.schema = step, schema
        self.sequence = self.group = TaskContext.get().partitionId() << PER_TASK

    def rows(self, sequences: list[tuple[int, list]], documents: dict[int, tuple]) -> Iterator[tuple]:
        groups = dealt([size for size, _ in sequences], self.step)
        for i in sorted(range(len(sequences)), key=groups.__getitem__):
            (size, window), offset = sequences[i], 0
            for document, start, length in window:
                name, ids = documents[document]
                yield (
                    name, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, self.sequence, offset,
                    size, self.group + groups[i],
                )
                offset += length
            self.sequence += 1
        self.group += max(groups, default=-1) + 1

    def batches(self, sequences: list[tuple[int, list]], documents: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
        waiting = []
        for row in self.rows(sequences, documents):
            waiting.append(row)
            if len(waiting) == ROWS_PER_BATCH:
                yield self._batch(waiting)
                waiting = []
        if waiting:
            yield self._batch(waiting)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), self.schema.types)], schema=self.schema)


def _task(shared, end_id: int, tiers: tuple[int, ...], block: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer, writer = loaded(shared.value), Packer(tiers), None
        end = np.asarray([end_id], "<u4").tobytes()
        documents: dict[int, tuple] = {}
        number = waiting = 0
        for batch in pieces(batches, "text"):
            if writer is None:
                longs = {c: pa.int64() for c in ("doc_tokens", "sequence_id", "offset", "context", "step_group")}
                writer = _Writer(step, pa.schema([
                    batch.schema.field("id"), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), *longs.items(),
                ]))
            for name, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                ids = tokens.ids(text) + end
                documents[number] = (name, ids)
                packer.route(number, len(ids) // 4)
                number, waiting = number + 1, waiting + len(ids) // 4
                if waiting >= block:
                    yield from writer.batches(packer.pack(), documents)
                    left = {d for stack in packer.store.by_length for d, _, _ in stack}
                    documents, waiting = {d: documents[d] for d in left}, 0
        if writer is not None:
            yield from writer.batches(packer.finish(), documents)

    return run


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = END_ID, tiers: tuple[int, ...] = TIERS, block: int = BLOCK_IDS,
    step: int = STEP_IDS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece of a document in a sequence.

    ``tokenizer`` is the path of a tokenizer file that the driver can read; its
    text is broadcast (a vocabulary, bounded). A piece has the document's
    ``id``, ``start`` and ``length`` in its ids, the ``ids`` themselves (unsigned
    32-bit, little-endian), ``doc_tokens``, its ``sequence_id`` and ``offset``
    there, the sequence's ``context`` size and its ``step_group``.
    """
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = (
        f"id {kind_of(docs, id_col)}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint,"
        " offset bigint, context bigint, step_group bigint"
    )
    rows = settled(docs, id_col, text_col).select("id", "text")
    return rows.mapInArrow(_task(shared, end_id, tuple(sorted(set(tiers), reverse=True)), block, step), schema)
