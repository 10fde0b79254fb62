"""Language identification: averaged hashed subword embeddings with a linear softmax.

Byte n-grams of lower-cased words (2, 3 and 4 bytes, word ends included) are
hashed to buckets. A text is the mean of its buckets' embeddings, and a linear
softmax gives the languages. Embeddings and softmax are trained together by
stochastic gradient descent in numpy on a bounded sample (``TRAIN_DOCS`` per
language, ``MOST_DOCS`` in all but at least one per language, so that all
languages are learned; whole texts and short pieces of them). The rejection is calibrated on
a part of the sample kept out of the training: a temperature, and the lowest
score at which nine of ten predictions are right.

Null texts and texts without a letter get ``und`` and score 0, no training
rows at all give ``und`` everywhere. Texts are scored whole. Ties go to the
language first in the alphabet. Only id, text and lang are read. Of rows that
repeat an id and a language the least text is learned; each row is predicted.
Texts of any length are counted in runs of ``RUN`` bytes, so memory does not grow
with the text; no n-gram is lost at a border of runs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hireplane.llm import batches as B
from hireplane.llm.samples import lowest_of_each

TRAIN_DOCS = 500
MOST_DOCS = 4000
BITS = 13
BUCKETS = 1 << BITS
DIM = 16
SIZES = (2, 3, 4)
UNKNOWN = "und"
RUN = 1 << 19
TEXTS_PER_RUN = 64

#: ASCII letters in lower case, bytes beyond ASCII, all else a blank.
FOLD = np.full(256, 0x20, dtype=np.uint8)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)


def folded(data: np.ndarray) -> np.ndarray:
    """Lower-case letters (ASCII and Latin-1 in UTF-8), other ASCII as blanks."""
    out = FOLD[data]
    upper = np.flatnonzero((out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97) & (out[:-1] == 0xC3)) + 1
    out[upper] += 0x20
    return out


def grams(data: np.ndarray, offsets: np.ndarray, stop: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per size: (bucket of each n-gram, number of n-grams that start before each text's end). ``stop``: only those that start before it."""
    text = folded(data).astype(np.uint32)
    for size in SIZES:
        n = max(0, len(text) - size + 1)
        code = np.zeros(n, np.uint32)
        for j in range(size):
            code = (code << np.uint32(8)) | text[j : j + n]
        inside = np.ones(n, bool)
        for cut in range(1, size):  # n-grams that reach into the next text
            at = offsets[1:-1] - cut
            inside[at[(at >= 0) & (at < n)]] = False
        # Of blanks, one at either end tells where a word starts or stops; two in a row tell nothing.
        inside &= ~((text[:n] == 0x20) & (text[1 : n + 1] == 0x20))
        at = np.flatnonzero(inside[:stop])
        bucket = ((code[at] + np.uint32(size)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        yield bucket, np.searchsorted(at, offsets)


def counts(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Texts x buckets: how often each text has the n-grams of a bucket, for some texts after the other."""

    def add(table: np.ndarray, part: np.ndarray, ends: np.ndarray, stop: int | None = None) -> None:
        for bucket, first in grams(part, ends, stop):
            owner = np.repeat(np.arange(len(table)), np.diff(first))
            table += np.bincount(owner * BUCKETS + bucket, minlength=table.size).reshape(table.shape)

    i, n = 0, len(offsets) - 1
    while i < n:
        fits = int(np.searchsorted(offsets, offsets[i] + RUN, side="right")) - 1
        j = min(n, i + TEXTS_PER_RUN, max(i + 1, fits))
        table = np.zeros((j - i, BUCKETS), np.int64)
        a, end = int(offsets[i]), int(offsets[j])
        if end - a <= RUN:
            add(table, data[a:end], offsets[i : j + 1] - a)
        while end - a > RUN or fits < j and a < end:  # one long text
            b = min(a + RUN, end)
            while b < end and data[b] & 0xC0 == 0x80:  # runs start with a character
                b += 1
            part = data[a : min(b + max(SIZES) - 1, end)]
            add(table, part, np.array([0, len(part)]), b - a)
            a = b
        yield table
        i = j


def shares(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its buckets and each one's share of the n-grams."""
    out = []
    for table in counts(data, offsets):
        for row in table:
            index = np.flatnonzero(row)
            out.append((index, (row[index] / max(1, row.sum())).astype(np.float32)))
    return out


def dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (index, share) in enumerate(rows):
        out[i, index] = share
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embeddings times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        weights = self.table.astype(np.float64)
        means = [(table / np.maximum(table.sum(1), 1)[:, None]) @ weights for table in counts(data, offsets)]
        return np.concatenate([np.zeros((0, len(self.languages))), *means]) + self.bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = self.logits(data, offsets) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, p[np.arange(len(p)), best]


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def train(
    rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], held: np.ndarray, epochs: int = 12, rate: float = 4.0, seed: int = 5,
) -> Model:
    """Fit embeddings and softmax by mini-batch gradient descent on the shares of ``rows``; calibrate on ``held``."""
    languages = sorted(set(langs))
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(lang) for lang in langs])
    if held.all() or not held.any():
        held = np.zeros(len(y), bool)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (DIM, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    order = np.flatnonzero(~held)
    scale = np.float32(8.0)  # means of many small embeddings are short
    for epoch in range(epochs):
        rng.shuffle(order)
        step = np.float32(rate * (1 - epoch / epochs))
        for start in range(0, len(order), 64):
            at = order[start : start + 64]
            x = dense([rows[i] for i in at])
            h = scale * (x @ emb)
            p = _softmax(h @ out + bias)
            p[np.arange(len(at)), y[at]] -= 1
            p /= len(at)
            back = p @ out.T
            out -= step * (h.T @ p)
            bias -= step * p.sum(0)
            emb -= step * scale * (x.T @ back)
    model = Model(languages, (scale * emb @ out).astype(np.float32), bias.astype(np.float64))
    check = np.flatnonzero(held) if held.any() else np.arange(len(y))
    z = np.concatenate([dense([rows[i] for i in at]) @ model.table for at in np.array_split(check, len(check) // 64 + 1) if len(at)]) + model.bias
    want = y[check]
    model.temperature = min(
        (0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0),
        key=lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(want)), want], 1e-12)).mean(),
    )
    p = _softmax(z / model.temperature)
    best, right = p.max(1), p.argmax(1) == want
    by = np.argsort(best)
    share = np.cumsum(right[by][::-1])[::-1] / np.arange(len(by), 0, -1)  # right among those with at least this score
    model.reject_below = float(best[by][np.argmax(share >= 0.9)]) if (share >= 0.9).any() else 1.0
    return model


def _training_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shares of every whole text and of short pieces from its start, middle and end."""
    for piece in B.pieces(batches, "text"):
        ids, langs = piece.column("id").to_pylist(), piece.column("lang").to_pylist()
        for i, text in enumerate(piece.column("text").to_pylist()):
            # Of very long texts three stretches stand for the words at the start, in the middle and at the end.
            half = len(text) // 2
            words = (text if len(text) <= RUN else " ".join([text[: RUN // 3], text[half : half + RUN // 3], text[-RUN // 3 :]])).split()
            parts = [text] + [" ".join(words[s : s + k]) for k in (3, 12) for s in (0, len(words) // 2, len(words) - k) if len(words) > 2 * k]
            rows = shares(*B.flat(pa.array(parts, pa.large_string())))
            yield pa.RecordBatch.from_pylist([
                {"id": str(ids[i]), "part": j, "lang": langs[i], "bucket": r[0].tolist(), "share": r[1].tolist()} for j, r in enumerate(rows)
            ], schema=pa.schema([
                ("id", pa.string()), ("part", pa.int32()), ("lang", pa.string()), ("bucket", pa.list_(pa.int32())), ("share", pa.list_(pa.float32())),
            ]))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_DOCS) -> Model | None:
    """Train on at most ``most`` rows per language and ``MOST_DOCS`` in all (at least one per language). ``labelled`` holds only rows that may be learned from."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
    )
    n_languages = rows.select("lang").distinct().count()
    if not n_languages:
        return None
    ids = lowest_of_each(rows.select("id", "lang"), "id", "lang", max(1, min(most, MOST_DOCS // n_languages)))
    # The ids are bounded by MOST_DOCS or the languages, what comes back by BUCKETS numbers for each of their few parts.
    picked = rows.join(F.broadcast(ids), ["id", "lang"], "left_semi").groupBy("id", "lang").agg(F.min("text").alias("text")).select("id", "text", "lang")
    parts = picked.mapInArrow(_training_rows, "id string, part int, lang string, bucket array<int>, share array<float>")
    table = parts.toArrow().sort_by([("id", "ascending"), ("part", "ascending"), ("lang", "ascending")]).combine_chunks()
    shares = [(np.asarray(b.values), np.asarray(s.values)) for b, s in zip(table["bucket"], table["share"])]
    number = {key: i for i, key in enumerate(dict.fromkeys(table["id"].to_pylist()))}
    held = np.array([number[key] % 5 == 4 for key in table["id"].to_pylist()], bool)
    return train(shares, table["lang"].to_pylist(), held) if shares else None


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, rejected (the calibrated score is too low to trust); whole texts, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for piece in B.pieces(batches, "text"):
            n = piece.num_rows
            letters = np.asarray(piece.column("letter").fill_null(False))
            if model is None:
                names, score = [UNKNOWN] * n, np.zeros(n)
                low = np.ones(n, bool)
            else:
                best, score = model.scores(*B.flat(B.strings(piece.column("text"))))
                names = [model.languages[i] if known else UNKNOWN for i, known in zip(best, letters)]
                score = np.where(letters, score, 0.0)
                low = score < model.reject_below
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), pa.array(names, pa.string()), pa.array(score), pa.array(low | ~letters)],
                names=["id", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(text_col).rlike(r"\p{L}").alias("letter"))
    out = rows.mapInArrow(score, f"id {kind}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", id_col)
