"""Quality classifier: Bradley-Terry ranking on preference pairs, thresholded at a score quantile.

A document has a strength ``w . x`` of its features. For a pair of a good and a
bad document the good one wins with probability ``sigmoid(w . (x_good -
x_bad))``; ``w`` is fitted to all pairs of a good and a bad labelled document by
logistic loss on the feature differences. Pairs are not formed: documents are
added up by label and narrow bin of strength, and all pairs of two bins share one
probability. The threshold is that quantile of all labelled documents' strengths
which splits them best, and the score is a sigmoid that is 0.3 there.

Features come from whole texts, by vectorised counts inside tasks. Null and
empty texts have all features 0 and are scored like any other text. Without
both labels all documents score 0.5. Repeated rows are scored
alike. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hireplane.llm import batches as B
from hireplane.llm.components import stored

CUT = 0.3
#: Bins of strength by which pairs are added up, and those of the threshold.
BINS, BIN_WIDTH, FINE = 512, 0.1, 1 << 17
PENALTY = 1e-3
MOST_ROUNDS, GAIN = 40, 1e-7
FEATURES = [
    "log_words", "word_length", "symbols", "bangs", "bars", "upper", "digits", "punctuation", "lines",
    "same_as_before", "distinct_words", "repeated_triples", "no_words",
]


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[np.frombuffer(chars, np.uint8)] = 1
    return out


CLASSES = {
    "symbols": _flags(b"#*$%&<>^~{}[]\\@_="), "bangs": _flags(b"!?"), "bars": _flags(b"|"),
    "upper": _flags(bytes(range(0x41, 0x5B))), "lower": _flags(bytes(range(0x61, 0x7B))),
    "digits": _flags(b"0123456789"), "punctuation": _flags(b".,;:"), "lines": _flags(b"\n"),
}


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct values per owner."""
    if not len(values):
        return np.zeros(n, np.int64)
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text."""
    n = len(offsets) - 1
    c = {name: _sums(table[data], offsets) for name, table in CLASSES.items()}
    starts, ends, first = B.word_spans(data, offsets, B.SPACED)
    words = np.diff(first)
    owner = np.repeat(np.arange(n), words)
    h = B.word_hashes(data, starts, ends)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    m = max(0, len(h) - 2)
    triple = B.mix(h[:m] * np.uint64(3) + B.mix(h[1 : m + 1] * np.uint64(5) + B.mix(h[2 : m + 2])))
    inside = owner[:m] == owner[2 : m + 2]
    triples = np.bincount(owner[:m][inside], minlength=n)
    w, chars, letters = np.maximum(words, 1), np.maximum(_sums(ends - starts, first), 1), np.maximum(c["upper"] + c["lower"], 1)
    return np.stack([
        np.log1p(words), chars / w / 10, c["symbols"] / w, c["bangs"] / w, c["bars"] / w, c["upper"] / letters, c["digits"] / chars,
        c["punctuation"] / w, c["lines"] / w, _sums(same, first) / w, _distinct(h, owner, n) / w,
        1 - _distinct(triple[inside], owner[:m][inside], n) / np.maximum(triples, 1) * (triples > 0) - (triples == 0), words == 0,
    ], axis=1).astype(np.float64)


def squashed(x: np.ndarray) -> np.ndarray:
    """Shares act mostly near zero: add square roots."""
    return np.concatenate([x, np.sqrt(np.maximum(x, 0))], axis=1)


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0
    steepness: float = 1.0

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((squashed(x) - self.mean) / self.scale, -8, 8) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.steepness * (self.strength(x) - self.threshold)
        return 1 / (1 + np.exp(-np.clip(z + np.log(CUT / (1 - CUT)), -30, 30)))


def _added(rows: DataFrame, told) -> np.ndarray:
    """Sum over all rows of the numbers that ``told(x, label)`` makes of a batch; tasks add up first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)
                part = told(x, np.asarray(batch.column("label")))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["numbers"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(v) for batch in batches for v in batch.column("numbers").to_pylist()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([sum(parts).tobytes()], pa.binary())], names=["numbers"])

    parts = rows.mapInArrow(run, "numbers binary")
    fewer = int(np.sqrt(rows.rdd.getNumPartitions()))
    if fewer > 1:
        parts = parts.repartition(fewer).mapInArrow(add, "numbers binary")
    return sum((np.frombuffer(r[0]) for r in parts.collect()), np.zeros(1))


def _by_bin(label: np.ndarray, strength: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by label (bad, good) and bin of strength."""
    place = np.clip(np.floor(strength / BIN_WIDTH) + BINS // 2, 0, BINS - 1).astype(np.int64) + BINS * (label == 1)
    order = np.argsort(place, kind="stable")
    first = np.flatnonzero(np.diff(place[order], prepend=-1))
    out = np.zeros((2 * BINS, values.shape[1]))
    out[place[order][first]] = np.add.reduceat(values[order], first)
    return out.ravel()


def _newton(bad: np.ndarray, good: np.ndarray, w: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Mean loss over all good-bad pairs at ``w``, what the next step should gain, and the step, from sums by bin: count, x, x times x (upper half)."""
    d = len(w)
    upper = np.triu_indices(d)
    bad, good = (part[part[:, 0] > 0] for part in (bad, good))
    (nb, xb, qb), (ng, xg, qg) = [(part[:, 0], part[:, 1 : d + 1], part[:, d + 1 :]) for part in (bad, good)]
    # Pairs of a bin of each label are as far apart as the bins' means, to first order.
    at_b, at_g = xb @ w / nb, xg @ w / ng
    gap = np.clip(at_g[:, None] - at_b[None, :], -500, 500)
    lost = 1 / (1 + np.exp(gap))
    bend = lost * (1 - lost)
    by_g, by_b = bend @ nb, ng @ bend
    square = np.zeros((d, d))
    square[upper] = by_g @ qg + by_b @ qb
    square = square + np.triu(square, 1).T
    cross = xg.T @ bend @ xb
    pairs = ng.sum() * nb.sum()
    within = square @ w - (by_g * at_g) @ xg - (by_b * at_b) @ xb
    slope = ((lost @ nb) @ xg - (ng @ lost) @ xb - within) / pairs - PENALTY * w
    step = np.linalg.solve((square - cross - cross.T) / pairs + PENALTY * np.eye(d), slope)
    return ng @ np.logaddexp(0, -gap) @ nb / pairs + PENALTY / 2 * w @ w, slope @ step, step


def fit_pairs(rows: DataFrame) -> Ranking | None:
    """Bradley-Terry weights from all good-bad pairs of ``rows`` (x, label), then the threshold quantile of all their strengths.

    Each round is one pass that adds up the rows by label and bin of strength;
    the driver gets a table of BINS rows, whatever the number of documents.
    """
    d = 2 * len(FEATURES)
    upper = np.triu_indices(d)

    def moments(x: np.ndarray, label: np.ndarray) -> np.ndarray:
        s = squashed(x)
        return np.concatenate([[(label == 1).sum(), (label == 0).sum()], s.sum(0)])

    sums = _added(rows, moments)
    if not np.any(sums) or not sums[0] or not sums[1]:
        return None
    n = sums[0] + sums[1]
    mean = sums[2:] / n
    spread = _added(rows, lambda x, label: ((squashed(x) - mean) ** 2).sum(0))
    model = Ranking(mean, np.maximum(np.sqrt(spread / n), 1e-6), np.zeros(d))

    def table(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def told(x: np.ndarray, label: np.ndarray) -> np.ndarray:
            z = np.clip((squashed(x) - model.mean) / model.scale, -8, 8)
            return _by_bin(label, z @ w, np.hstack([np.ones((len(z), 1)), z, z[:, upper[0]] * z[:, upper[1]]]))

        both = _added(rows, told).reshape(2, BINS, -1)
        return both[0], both[1]

    w, step, before = model.weights, np.zeros(d), np.inf
    for _ in range(MOST_ROUNDS):
        loss, gain, found = _newton(*table(w + step), w + step)
        if loss > before + GAIN:  # too far
            step = step / 2
            continue
        w, step, before = w + step, found, loss
        if gain < GAIN:
            break
    # Sums in another order differ in the last digits.
    model.weights = np.round(w, 9)
    # Counts by fine bins of all strengths, which the clipped features bound.
    reach = 8 * np.abs(model.weights).sum() + 1e-6

    def counts(x: np.ndarray, label: np.ndarray) -> np.ndarray:
        place = np.clip((model.strength(x) + reach) / (2 * reach) * FINE, 0, FINE - 1).astype(np.int64)
        return np.bincount(place + FINE * (label == 1), minlength=2 * FINE).astype(np.float64)

    bad, good = _added(rows, counts).reshape(2, FINE)
    edges = np.linspace(-reach, reach, FINE + 1)
    middle = (edges[1:] + edges[:-1]) / 2
    at = lambda part, q: np.searchsorted(np.cumsum(part), np.asarray(q) * part.sum())
    # Quantiles of all strengths; both labels count at their share.
    cuts = np.unique(at(good + bad, np.linspace(0, 1, 801)).clip(0, FINE - 1))
    below = lambda part: np.concatenate([[0], np.cumsum(part)])[cuts] / part.sum()
    wrong = below(good) + 1 - below(bad)
    best = np.flatnonzero(np.isclose(wrong, wrong.min()))
    model.threshold = float(edges[cuts[best[len(best) // 2]]])
    apart = middle[at(good, 0.5)] - middle[at(bad, 0.5)]
    model.steepness = float(4 / max(apart, 1e-6))
    return model


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``x``, the array of FEATURES."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in B.pieces(batches, "text"):
            x = features(*B.flat(B.strings(piece.column("text"))))
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([piece.column("id"), lists], names=["id", "x"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, x array<double>").withColumnRenamed("id", id_col)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranking | None:
    """Fit on every labelled document; ``labels`` holds only rows that may be learned from.

    Features are made where the texts are read, so only a few numbers per document meet the labels.
    """
    known = labels.select(id_col, F.col(label_col).cast("int").alias("label")).where(F.col(label_col).isin(0, 1))
    x = with_features(docs.select(id_col, text_col), id_col, text_col)
    return fit_pairs(stored(x.join(known, id_col).select("x", "label"), "labelled"))


def score(docs: DataFrame, model: Ranking | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted (score >= 0.3); no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for piece in B.pieces(batches, "text"):
            x = features(*B.flat(B.strings(piece.column("text"))))
            s = np.full(len(x), 0.5) if model is None else model.scores(x)
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["id", "score", "predicted"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, model: Ranking | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are predicted to be good, with their columns; no shuffle, so ids may repeat or be null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def good(texts: pa.Array) -> pa.Array:
        x = features(*B.flat(B.strings(texts)))
        return pa.array(np.ones(len(x), bool) if model is None else shared.value.scores(x) >= CUT)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in B.pieces(batches, text_col):
            yield piece.filter(good(piece.column(text_col)))

    return docs.mapInArrow(run, docs.schema)
