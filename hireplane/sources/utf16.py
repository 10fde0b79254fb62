"""Splittable reading of UTF-16 tables with quoted line breaks.

Spark's own reader splits lines at the bytes of a line feed wherever they stand:
inside a quoted cell, and across two characters (the end of one and the start of
the next). Reading such a file whole, in one task, is right but does not scale.

Here a file is read in byte ranges. A first pass tells for every range what it
does to the two things a range has to know at its start: whether its first byte
is the first of a character, and whether it stands inside a quoted cell. As both
are unknown while ranges are read side by side, the pass tells it for each case.
The driver puts the ranges in line (a few numbers per range), and a second pass
reads the ranges with their true start. Only rows that cross a border between
ranges are put together by a shuffle.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hireplane.session import first_bytes

_LITTLE, _BIG = "UTF-16LE", "UTF-16BE"
_RANGE = "file STRING, start BIGINT, shift INT, next_shift INT, quotes INT, done0 BOOLEAN, done1 BOOLEAN"
_LINES = "file STRING, opener BIGINT, start BIGINT, first BOOLEAN, line STRING, part BINARY"


def byte_order(spark: SparkSession, file: str) -> str:
    """By the mark at the start of the file; without one big-endian, as the name UTF-16 stands for."""
    return _LITTLE if first_bytes(spark, file, 2) == b"\xff\xfe" else _BIG


@dataclass
class _Records:
    """Records of one range that follow each other: their bytes, and where each begins and the last one ends."""

    file: str
    start: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def __getitem__(self, n: int) -> bytes:
        return self.data[self.bounds[n] : self.bounds[n + 1]].tobytes()

    def part(self, first: int, end: int) -> _Records:
        return _Records(self.file, self.start, self.data, self.bounds[first : end + 1])

    def after(self, shift: int, quoted: int, little: bool) -> tuple[np.ndarray, np.ndarray]:
        """What is said of the first byte, and whether it stands inside quotes, after each record, if before the first it is ``shift`` and ``quoted``."""
        shifts = (shift + self.bounds - self.bounds[0]) & 1
        low, end = self.bounds[0], self.bounds[-1]
        at = low + np.flatnonzero(self.data[low:end] == 0x22)
        if not len(at):
            return shifts[1:], np.full(len(self), quoted)
        record = np.searchsorted(self.bounds, at, "right") - 1
        other = at + 1 if little else at - 1
        first = np.minimum(at, other) - self.bounds[record] - shifts[record]
        whole = (first >= 0) & (first & 1 == 0) & (np.maximum(at, other) < self.bounds[record + 1])
        whole[whole] = self.data[other[whole]] == 0
        quotes = np.bincount(record[whole], minlength=len(self))
        return shifts[1:], (quoted + np.cumsum(quotes)) & 1

    def lines(self, little: bool) -> pa.Array:
        """The records as text, each of whole characters."""
        low, end = self.bounds[0], self.bounds[-1]
        pairs = self.data[low:end].reshape(-1, 2)
        letters, over = (pairs[:, 0], pairs[:, 1]) if little else (pairs[:, 1], pairs[:, 0])
        if not over.any() and not (letters & 0x80).any():
            bounds = ((self.bounds - low) // 2).astype(np.int32)
            return pa.StringArray.from_buffers(len(self), pa.py_buffer(bounds.tobytes()), pa.py_buffer(letters.tobytes()))
        return pa.array([self[n].decode(_LITTLE if little else _BIG, "replace") for n in range(len(self))], pa.string())


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[_Records]:
    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts, values = batch.column("file"), batch.column("start").to_numpy(), batch.column("value").cast(pa.binary())
        _, bounds, data = values.buffers()
        bounds = np.frombuffer(bounds, np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        other = (starts[1:] != starts[:-1]) | pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(other) + 1).tolist(), len(values)]
        for first, end in zip(cuts, cuts[1:]):
            yield _Records(files[first].as_py(), int(starts[first]), data, bounds[first : end + 1])


@dataclass
class _Case:
    """A range read as if its first character started at ``shift``: what it has come to so far."""

    shift: int
    quotes: int = 0
    #: A row ended in the range, if it began outside (0) or inside (1) a quoted cell.
    done: list[bool] = field(default_factory=lambda: [False, False])

    def read(self, records: _Records, little: bool) -> None:
        shifts, quotes = records.after(self.shift, self.quotes, little)
        for q in (0, 1):
            self.done[q] |= bool(((shifts == 0) & (quotes == q)).any())
        self.shift, self.quotes = int(shifts[-1]), int(quotes[-1])


def _tell_ranges(little: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cases: dict[tuple[str, int], list[_Case]] = {}
        for records in _runs(batches):
            for case in cases.setdefault((records.file, records.start), [_Case(0), _Case(1)]):
                case.read(records, little)
        rows = [
            (file, start, shift, c.shift, c.quotes, *c.done)
            for (file, start), both in cases.items() for shift, c in enumerate(both)
        ]
        if rows:
            names = ["file", "start", "shift", "next_shift", "quotes", "done0", "done1"]
            types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def in_line(told: list) -> dict[tuple[str, int], tuple[int, int, int]]:
    """(shift, inside quotes, start of the range in which the open row began) at the start of every range."""
    by_range: dict[tuple[str, int], dict[int, object]] = {}
    for r in told:
        by_range.setdefault((r.file, r.start), {})[r.shift] = r
    out, at = {}, None
    for file, start in sorted(by_range):
        if at is None or at[0] != file:
            at = file, 0, 0, start
        _, shift, quoted, opener = at
        out[file, start] = shift, quoted, opener
        case = by_range[file, start][shift]
        began_here = (case.done0, case.done1)[quoted] or not (shift or quoted)
        at = file, case.next_shift, quoted ^ case.quotes, start if began_here else opener
    return out


def _read_ranges(little: bool, states):
    feed = b"\n\0" if little else b"\0\n"
    mark = b"\xff\xfe" if little else b"\xfe\xff"
    name = _LITTLE if little else _BIG

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple | pa.Array]:
        """Single rows, and runs of whole lines, none of them the first of a file, as one array each."""
        at, opener, parts, first, shift, quoted = None, None, [], False, 0, 0

        def row(whole: bool) -> tuple:
            data = b"".join(parts)
            if whole and opener is None:
                return at[0], None, at[1], first, data.decode(name, "replace"), None
            return at[0], at[1] if opener is None else opener, at[1], first, None, data

        for records in _runs(batches):
            fresh = at != (records.file, records.start)
            if fresh:
                if parts:
                    yield row(False)
                at, parts = (records.file, records.start), []
                shift, quoted, began = states.value[at]
                opener, first = (began if shift or quoted else None), records.start == 0
                if opener is not None:
                    parts = [feed]
            shifts, quotes = records.after(shift, quoted, little)
            ends = (shifts == 0) & (quotes == 0)
            # A record is a whole line if it begins and ends between rows.
            whole = ends & np.concatenate([[not parts and not first and opener is None], ends[:-1]])
            cuts = [0, *(np.flatnonzero(whole[1:] != whole[:-1]) + 1).tolist(), len(records)]
            for low, end in zip(cuts, cuts[1:]):
                if whole[low]:
                    yield records.part(low, end).lines(little)
                    continue
                for n in range(low, end):
                    record = records[n]
                    if fresh and n == 0:
                        if records.start == 0 and record.startswith(mark):
                            record = record[2:]
                    elif parts:
                        parts.append(feed)
                    parts.append(record)
                    if ends[n]:
                        yield row(True)
                        parts, opener, first = [], None, False
            shift, quoted = int(shifts[-1]), int(quotes[-1])
        if parts:
            yield row(False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "opener", "start", "first", "line", "part"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.binary()]
        waiting: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting), types)], names=names)

        for line in lines(batches):
            if isinstance(line, pa.Array):
                columns = [pa.nulls(len(line), t) for t in types]
                columns[3], columns[4] = pa.array(np.zeros(len(line), bool)), line
                yield pa.RecordBatch.from_arrays(columns, names=names)
                continue
            waiting.append(line)
            if len(waiting) == 4096:
                yield batch()
                waiting.clear()
        if waiting:
            yield batch()

    return run


def utf16_lines(spark: SparkSession, files: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """``line`` and ``first`` (of its file) for every row of the files, which have one byte order; blank rows are left out.

    Rows within one range and rows that cross a border between ranges.
    """
    little = order == _LITTLE
    raw = spark.read.option("encoding", order).option("lineSep", "\n").text(files).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("value"),
    )
    told = raw.mapInArrow(_tell_ranges(little), _RANGE).collect()
    states = spark.sparkContext.broadcast(in_line(told))
    read = raw.mapInArrow(_read_ranges(little, states), _LINES)
    whole = read.where(F.col("line").isNotNull()).select("first", "line")
    crossing = read.where(F.col("line").isNull()).groupBy("file", "opener").agg(
        F.max("first").alias("first"), F.sort_array(F.collect_list(F.struct("start", "part"))).alias("parts"),
    )
    joined = F.aggregate("parts", F.lit(b""), lambda out, p: F.concat(out, p["part"]))
    line = F.regexp_replace("line", r"\r$", "").alias("line")
    rows = whole, crossing.select("first", F.decode(joined, order).alias("line"))
    return tuple(r.select("first", line).where(F.col("line") != "") for r in rows)


def read_utf16_table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """The rows of all UTF-16 files of ``path`` as text columns, named by the first file's header.

    Every file begins with a header. Cells are quoted as in Spark's reader; empty
    ones are null, short rows end with nulls, cells beyond the header are left out.
    """
    files = sorted(r.path for r in spark.read.format("binaryFile").load(path).select("path").collect())
    by_order: dict[str, list[str]] = {}
    for file in files:
        by_order.setdefault(byte_order(spark, file), []).append(file)
    parts = [part for order, some in by_order.items() for part in utf16_lines(spark, some, order)]
    # A header mostly stands in one range: the rows that cross borders, for which all is read, are not put together for it then.
    head = next((row for part in parts if (row := part.where("first").first()) is not None), None)
    lines = reduce(DataFrame.unionAll, parts) if parts else None
    if head is None:
        raise ValueError(f"no header in {path}")
    names = next(csv.reader([head.line], delimiter=sep))
    fields = [f"_c{i}" for i in range(len(names))]
    cells = F.from_csv("line", ", ".join(f"{f} STRING" for f in fields), {"sep": sep})
    body = lines.where(~F.col("first")).select(cells.alias("c"))
    return body.select(*[F.col(f"c.{f}").alias(n) for f, n in zip(fields, names)])
