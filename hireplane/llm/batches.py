"""Texts of Arrow batches as flat byte arrays, for vectorised work inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20
WHITE = bytes([0x20, *range(0x09, 0x0E)])


def word_table(separators: bytes) -> np.ndarray:
    """True for the bytes that words are made of."""
    table = np.ones(256, dtype=bool)
    table[np.frombuffer(separators, dtype=np.uint8)] = False
    return table


#: Words between ASCII white space.
SPACED = word_table(WHITE)
#: Runs of ASCII digits, lower-case letters and anything beyond ASCII.
ALNUM = word_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def strings(column: pa.Array) -> pa.Array:
    """As a string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array without nulls; text i is bytes[offsets[i]:offsets[i+1]]."""
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of one piece take about ``limit`` bytes; a longer text is a piece of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): words as byte ranges; text i has words first[i] to first[i+1]."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    cuts = offsets[1:][offsets[1:] > 0] - 1
    after[cuts] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Rolling:
    """Hashes of ranges of a sequence from prefix sums of ``value * base**i`` modulo 2**64."""

    def __init__(self, base: int):
        self.base = np.uint64(base | 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            step = np.full(n, self.base, np.uint64)
            step[0] = 1
            self.up = np.cumprod(step)
            step[1:] = self.inverse
            self.down = np.cumprod(step)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._powers(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.up[: len(values)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of values[starts[i]:ends[i]] for each i, alike wherever the range stands."""
        return mix((prefix[ends] - prefix[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


BYTES = Rolling(0x9E3779B97F4A7C15)
WORDS = Rolling(0xD1B54A32D192ED03)
WORDS2 = Rolling(0x8CB92BA72F3D8DD7)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return BYTES.ranges(BYTES.prefix(data), starts, ends)
