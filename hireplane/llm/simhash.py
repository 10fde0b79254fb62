"""SimHash near-duplicates by multi-index hashing.

A fingerprint bit is 1 where over half of the 64-bit hashes of a text's word
shingles have it. Two fingerprints link when at most ``distance`` bits differ.

Search over distinct fingerprints: the 64 bits are cut into ``n`` parts, so two
linked fingerprints differ by at most ``distance // n`` bits in one part at
least. Every fingerprint goes into a table under each of its parts, asks for
all values in a small Hamming ball around each part, and the full distance is
verified on what it gets. Where the radius is 1, of two parts that differ the
one with fewer ones asks, which halves the balls and loses nothing. Any number
of parts gives the same classes; it is taken from the number of fingerprints,
so that a part has more values than would crowd it (see ``parts_for``).

Crowded parts (more than ``CROWD`` fingerprints under one value) would give
pairs by the square. There fingerprints are first linked to the least one that
shares the part and a second part of the bits (verified as well), these stars
are contracted to components, and only pairs across different components are
looked for. A pair inside one component adds nothing to the classes.

Null, empty and blank texts have fingerprint zero and link like any other.
Shorter texts than the shingle are one shingle. Equal texts share a
fingerprint and a class. Repeated ids are one document for the class id's
minimum, each row is kept. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hireplane.llm import batches as B
from hireplane.llm.components import connected, stored

SHINGLE = 4
DISTANCE = 4
SEED = 42
CROWD = 64


def bits_of(data: bytes, n_words: int, starts: list[int], ends: list[int], shingle: int) -> list[int]:
    """XXH64 of every shingle of one normalised text (words with single blanks between)."""
    digest = xxhash.xxh64_intdigest
    if n_words <= shingle:
        return [digest(data, SEED)] if n_words else []
    return [digest(data[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id and ``fp`` (the fingerprint as a signed long); no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in B.pieces(batches, "text"):
            data, offsets = B.flat(B.strings(piece.column("text")))
            data = B.LOWER[data]
            starts, ends, first = B.word_spans(data, offsets, B.SPACED)
            # Words with one blank between: keep the words and the byte after each.
            keep = B.SPACED[data]
            keep[ends[ends < len(data)]] = True
            data = np.where(B.SPACED[data], data, np.uint8(0x20))
            place = np.zeros(len(data) + 1, np.int64)
            np.cumsum(keep, out=place[1:])
            packed = data[keep].tobytes()
            starts, ends = place[starts], place[ends]
            out = np.zeros(piece.num_rows, np.uint64)
            for i in range(piece.num_rows):
                a, b = first[i], first[i + 1]
                if a < b:
                    base = starts[a]
                    text = packed[base : ends[b - 1]]
                    h = np.array(bits_of(text, b - a, (starts[a:b] - base).tolist(), (ends[a:b] - base).tolist(), shingle), np.uint64)
                    out[i] = majority(h)
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(out.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fp bigint").withColumnRenamed("id", id_col)


def majority(hashes: np.ndarray) -> np.uint64:
    """Bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[start : start + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]


def parts_for(n_prints: int, distance: int = DISTANCE, crowd: int = CROWD) -> int:
    """The most parts whose values, evenly used, hold at most ``crowd`` fingerprints each; balls are smallest then.

    At least two, as a cell's value takes at most 32 bits; at most such that the balls have a radius of 1.
    """
    n = max(2, distance // 2 + 1)
    while n > 2 and n_prints > crowd << 64 // n:
        n -= 1
    return n


def segments(n: int) -> list[tuple[int, int]]:
    """(shift, width) of ``n`` parts of 64 bits."""
    widths = [64 // n + (i < 64 % n) for i in range(n)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _part(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def _cell(number: int, value: Column) -> Column:
    """Part number and value as one long; values take at most 32 bits."""
    return value.bitwiseOR(F.lit(number << 40).cast("bigint"))


def _ball(width: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` ones."""
    masks = [0]
    for _ in range(radius):
        masks = sorted({m | 1 << b for m in masks for b in range(width)} | set(masks))
    return masks


def distance_of(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(prints: DataFrame, distance: int = DISTANCE, n_segments: int | None = None, crowd: int = CROWD) -> DataFrame:
    """(a, b): enough verified links between the distinct ``fp`` of ``prints`` to connect all that are linked.

    Outside crowded cells these are all links; in them, links inside one component may be missing.
    """
    n_segments = n_segments or parts_for(prints.count(), distance, crowd)
    parts, radius = segments(n_segments), distance // n_segments
    fp = F.col("fp")
    cells = prints.select(F.explode(F.array(*[_cell(i, _part(fp, s, w)) for i, (s, w) in enumerate(parts)])).alias("cell"), "fp")
    asks = None
    for i, (s, w) in enumerate(parts):
        value, masks = _part(fp, s, w), F.array(*[F.lit(m).cast("bigint") for m in _ball(w, radius)])
        if radius == 1:
            masks = F.filter(masks, lambda m: m.bitwiseAND(value) == 0)
        part = prints.select(F.explode(F.transform(masks, lambda m: _cell(i, value.bitwiseXOR(m)))).alias("cell"), "fp", _cell(i, value).alias("own"))
        asks = part if asks is None else asks.unionAll(part)
    asks = asks.select("cell", F.col("fp").alias("a"), (F.col("cell") == F.col("own")).alias("same") if radius == 1 else F.lit(True).alias("same"))
    near = distance_of(F.col("a"), F.col("b")) <= distance
    once = ~F.col("same") | (F.col("a") < F.col("b"))
    full = stored(cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("cell"), "crowded")
    table = cells.withColumnRenamed("fp", "b")
    if full.isEmpty():
        return asks.join(table, "cell").where(once & near).select("a", "b")
    plain = asks.join(table.join(full, "cell", "left_anti"), "cell").where(once & near).select("a", "b")
    return plain.unionAll(_crowded_links(asks, table, full, near & once, distance))


def _crowded_links(asks: DataFrame, table: DataFrame, full: DataFrame, near: Column, distance: int) -> DataFrame:
    """Stars inside crowded cells, then links between their components."""
    members = stored(table.join(full, "cell"), "members")
    parts = segments(4)
    rays = members.select("cell", "b", F.explode(F.array(*[_cell(i, _part(F.col("b"), s, w)) for i, (s, w) in enumerate(parts)])).alias("part"))
    centres = rays.groupBy("cell", "part").agg(F.min("b").alias("a"))
    stars = stored(
        rays.join(centres, ["cell", "part"]).where((F.col("a") != F.col("b")) & (distance_of(F.col("a"), F.col("b")) <= distance))
        .select("a", "b").distinct(), "stars",
    )
    group = stored(connected(stars), "groups")
    # Asking and asked fingerprints of crowded cells with their component; one that has none is its own.
    of = lambda rows, name: rows.join(group.withColumnRenamed("node", name), name, "left").withColumn("component", F.coalesce("component", name))
    asked = of(members, "b").withColumnRenamed("component", "of_b")
    asking = of(asks.join(full, "cell"), "a").withColumnRenamed("component", "of_a")
    # The largest component of a cell need not meet itself.
    sizes = asked.groupBy("cell", "of_b").agg(F.count("*").alias("n"))
    major = sizes.groupBy("cell").agg(F.max_by("of_b", F.struct("n", "of_b")).alias("major"))
    asked = asked.join(major, "cell").select("cell", "b", "of_b", (F.col("of_b") == F.col("major")).alias("kind"))
    both, minor = F.array(F.lit(True), F.lit(False)), F.array(F.lit(False))
    asking = asking.join(major, "cell").select(
        "cell", "a", "of_a", "same", F.explode(F.when(F.col("of_a") == F.col("major"), minor).otherwise(both)).alias("kind"),
    )
    found = asking.join(asked, ["cell", "kind"]).where((F.col("of_a") != F.col("of_b")) & near)
    return found.select("a", "b").unionAll(stars)


def classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE,
    n_segments: int | None = None, crowd: int = CROWD,
) -> DataFrame:
    """Per document: id, ``fp``, ``component_id`` (the least id of its class)."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min(id_col).alias("first_id")), "distinct")
    found = connected(links(distinct.select("fp"), distance, n_segments, crowd))
    of = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = of.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_print = of.join(least, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select(id_col, "fp", "component_id")


def one_row_per_id(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the first row of every id, in hash order of the whole row.

    Ids are counted alone. Only rows of ids that repeat are reduced, by an
    aggregate that combines before the shuffle.
    """
    many = docs.groupBy(F.col(id_col).alias("_many")).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select("_many")
    many = stored(many, "repeated-ids")
    if many.isEmpty():
        return docs
    repeats = docs[id_col].eqNullSafe(many["_many"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    least = docs.join(many, repeats, "left_semi").groupBy(F.col(id_col).alias("_many")).agg(
        F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("_row")
    )
    return docs.join(many, repeats, "left_anti").unionAll(least.select("_row.*"))


def _kept(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    docs = one_row_per_id(docs, id_col)
    first = classes(docs, id_col, text_col, **options).select(F.col("component_id").alias("_keep")).distinct()
    return docs.join(first, docs[id_col].eqNullSafe(first["_keep"]), "left_semi")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of every class, that with the least id, with all its columns.

    Rows that repeat an id are one document: the first of them in hash order of the whole row, before classes are formed.
    Rows without an id are documents of their own, told apart by a hash of the whole row; they come after all ids.
    """
    if docs.where(F.col(id_col).isNull()).isEmpty():
        return _kept(docs, id_col, text_col, **options)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key = "_key"
    while key in docs.columns:
        key = "_" + key
    unnamed = F.col(id_col).isNull()
    told = F.struct(unnamed.alias("unnamed"), F.col(id_col).alias("id"), F.when(unnamed, F.xxhash64(*columns)).alias("digest"))
    return _kept(docs.withColumn(key, told), key, text_col, **options).select(*columns)
