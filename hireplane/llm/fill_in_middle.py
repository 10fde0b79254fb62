"""Fill-in-the-middle transformation by secondary sort.

A text is a run of units (a run of ASCII letters, or one other character). Two
numbers hashed from the document's id cut it between units into prefix, middle
and suffix. A task walks its texts once and emits them in pieces of at most
``chunk`` units, keyed by (row, place in the output), with a marker before each
part. One shuffle by row with a sort by place inside the partitions lays the
pieces out as the output reads; a task then streams them into running SHA-256
digests and never holds a text, however long.

The way back uses the laid-out pieces and the form alone: the markers say which
part follows, the pieces get their place in the source text, and a second sort
inside the same partitions, without another shuffle, streams them into the
digest of the restored text.

The shuffle is ``repartition`` and ``sortWithinPartitions``, the DataFrame form
of ``repartitionAndSortWithinPartitions``: sorting spills on the JVM side.

Null texts count as empty; an empty text has no unit and stays plain. A null id
is hashed as an empty one. Rows that repeat an id, or repeat as a whole, are
rows of their own with results of their own. Other columns are not looked at,
whatever their names. An empty table gives an empty one. One unit is never cut,
so a piece is as long as the longest run of letters at least.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from hireplane.llm.batches import flat, pieces, strings
from hireplane.llm.rowkeys import kind_of, numbered

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
PLAIN, PSM, SPM = "plain", "psm", "spm"
CHUNK_UNITS = 8192
ROWS_PER_BATCH = 4096
#: Order of the parts in the source text.
SOURCE_ORDER = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}


def draws(name: str, seed: int) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 from the id as text."""
    digest = hashlib.sha256(f"{seed}:{name}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, first): byte places of units in UTF-8 texts; text i has the units first[i] to first[i + 1]."""
    folded = data | 0x20
    letter = (folded >= 0x61) & (folded <= 0x7A)
    after_letter = np.zeros_like(letter)
    after_letter[1:] = letter[:-1]
    after_letter[offsets[:-1][offsets[:-1] < len(data)]] = False
    begins = ((data & 0xC0) != 0x80) & ~(letter & after_letter)
    starts = np.flatnonzero(begins)
    return starts, np.searchsorted(starts, offsets)


def _cutter(kind: str, seed: int, middle_percent: int, spm_percent: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts = strings(batch.column("text"))
            data, offsets = flat(texts)
            starts, first = unit_starts(data, offsets)
            chars = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
            marked = np.zeros(len(texts), bool)
            for marker in MARKERS:
                marked |= pc.match_substring(texts, marker.decode()).to_numpy(zero_copy_only=False)
            out = _Rows(batch.column("id"))
            rows, names, raw = batch.column("row").to_pylist(), batch.column("name").to_pylist(), data.tobytes()
            for i, row in enumerate(rows):
                n = int(first[i + 1] - first[i])
                h1, h2, h3, h4 = draws(names[i], seed)
                bounds = np.append(starts[first[i] : first[i + 1]], offsets[i + 1])
                if n == 0 or marked[i] or h3 % 100 >= middle_percent:
                    out.head(i, row, n, PLAIN, None, None)
                    out.part(row, raw, bounds, 0, n, chunk)
                    continue
                a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                form = SPM if h4 % 100 < spm_percent else PSM
                at = [int(chars[bounds[k]]) for k in (0, a, b)]
                out.head(i, row, n, form, at[1] - at[0], at[2] - at[1])
                parts = {PREFIX: (0, a), SUFFIX: (b, n), MIDDLE: (a, b)}
                for marker in (SUFFIX, PREFIX, MIDDLE) if form == SPM else MARKERS:
                    out.piece(row, marker)
                    out.part(row, raw, bounds, *parts[marker], chunk)
            yield out.batch(kind)

    return run


class _Rows:
    """Pieces of one batch, column by column; a document's head is its piece at place 0 and holds no text."""

    def __init__(self, ids: pa.Array):
        self.ids, self.owner = ids, []
        self.columns: dict[str, list] = {c: [] for c in ("row", "place", "piece", "n", "form", "prefix_chars", "middle_chars")}

    def _add(self, owner, *values) -> None:
        self.owner.append(owner)
        for column, value in zip(self.columns.values(), values):
            column.append(value)

    def head(self, i: int, row: int, n: int, form: str, prefix: int | None, middle: int | None) -> None:
        self._add(i, row, 0, b"", n, form, prefix, middle)
        self.place = 0

    def piece(self, row: int, value: bytes) -> None:
        self.place += 1
        self._add(None, row, self.place, value, None, None, None, None)

    def part(self, row: int, raw: bytes, bounds: np.ndarray, start: int, end: int, chunk: int) -> None:
        for k in range(start, end, chunk):
            self.piece(row, raw[bounds[k] : bounds[min(end, k + chunk)]])

    def batch(self, kind: str) -> pa.RecordBatch:
        types = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        arrays = [pa.array(v, t) for v, t in zip(self.columns.values(), types)]
        ids = self.ids.take(pa.array(self.owner, pa.int64()))
        return pa.RecordBatch.from_arrays([ids, *arrays], names=["id", *self.columns])


def output_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, middle_percent: int = 90,
    spm_percent: int = 20, chunk: int = CHUNK_UNITS,
) -> DataFrame:
    """The transformed texts in pieces, each document whole in one partition and in the order of its output.

    ``row`` numbers the documents, ``place`` their pieces. Place 0 holds no text
    but ``id``, ``n`` (units), ``form`` and the lengths of prefix and middle in
    characters; ``piece`` is UTF-8.
    """
    kind = kind_of(docs, id_col)
    schema = f"id {kind}, row bigint, place int, piece binary, n bigint, form string, prefix_chars bigint, middle_chars bigint"
    cut = numbered(docs, id_col, text_col).mapInArrow(_cutter(kind, seed, middle_percent, spm_percent, chunk), schema)
    return cut.repartition("row").sortWithinPartitions("row", "place")


META = ["id", "n", "form", "prefix_chars", "middle_chars"]


def _stream(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in columns])


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while waiting := list(islice(rows, ROWS_PER_BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting), schema.types)], schema=schema)


def _first(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Schema | None, Iterator[pa.RecordBatch]]:
    first = next(batches, None)
    return (None, iter(())) if first is None else (first.schema, chain([first], batches))


def _digest_output(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each output, and its pieces keyed by (part, place) of the source text, read from the markers."""
    found, batches = _first(batches)
    if found is None:
        return

    def rows():
        row, digest, meta, part = None, None, (), 0
        for now, place, piece, *told in _stream(batches, ["row", "place", "piece", *META]):
            if place == 0:
                if row is not None:
                    yield row, -1, 0, None, *meta, digest.hexdigest()
                row, digest, meta, part = now, hashlib.sha256(), told, 0
                continue
            digest.update(piece)
            if meta[2] != PLAIN and piece in SOURCE_ORDER:
                part = SOURCE_ORDER[piece]
            else:
                yield row, part, place, piece, *[None] * (len(META) + 1)
        if row is not None:
            yield row, -1, 0, None, *meta, digest.hexdigest()

    fields = [("row", pa.int64()), ("part", pa.int32()), ("place", pa.int32()), ("piece", pa.binary())]
    yield from _batched(rows(), pa.schema([*fields, *[found.field(c) for c in META], ("output_sha256", pa.string())]))


def _digest_source(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, batches = _first(batches)
    if found is None:
        return

    def rows():
        row, meta, digest = None, (), None
        for now, part, piece, *told in _stream(batches, ["row", "part", "piece", *META, "output_sha256"]):
            if part < 0:
                if row is not None:
                    yield row, *meta, digest.hexdigest()
                row, meta, digest = now, told, hashlib.sha256()
            else:
                digest.update(piece)
        if row is not None:
            yield row, *meta, digest.hexdigest()

    fields = [found.field(c) for c in META]
    ends = [("output_sha256", pa.string()), ("restored_sha256", pa.string())]
    yield from _batched(rows(), pa.schema([("row", pa.int64()), *fields, *ends]))


def digests(output: DataFrame) -> DataFrame:
    """Per document its head, ``output_sha256`` and ``restored_sha256``, from ``output_pieces`` as they lie."""
    head = f"id {kind_of(output, 'id')}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string"
    back = output.mapInArrow(_digest_output, f"row bigint, part int, place int, piece binary, {head}")
    back = back.sortWithinPartitions("row", "part", "place")
    return back.mapInArrow(_digest_source, f"row bigint, {head}, restored_sha256 string")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("row", pa.int64()), ("output", pa.string())])

    def rows():
        row, found = None, []
        for now, place, piece in _stream(batches, ["row", "place", "piece"]):
            if place == 0:
                if row is not None:
                    yield row, b"".join(found).decode()
                row, found = now, []
            found.append(piece)
        if row is not None:
            yield row, b"".join(found).decode()

    return _batched(rows(), schema)


def output_texts(output: DataFrame) -> DataFrame:
    """``row`` and the whole transformed text, for texts that fit into a value."""
    return output.mapInArrow(_joined, "row bigint, output string")


def restored(text: str, form: str) -> str:
    """The source of one transformed text."""
    if form == PLAIN:
        return text
    rest, middle = text.split(MIDDLE.decode())
    if form == PSM:
        prefix, suffix = rest.removeprefix(PREFIX.decode()).split(SUFFIX.decode())
    else:
        suffix, prefix = rest.removeprefix(SUFFIX.decode()).split(PREFIX.decode())
    return prefix + middle + suffix
