"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length.

Texts and terms are folded alike: case, compatibility forms, look-alike letters
of other alphabets, and digits or signs inside words that stand for letters;
``l`` and ``i`` fall together because ``1`` stands for both. All other signs are
blanks, so words stand between single blanks and a term is matched at word
borders; a term that ends in ``*`` is a word beginning.

The lexicon is learned from a bounded labelled sample (``TRAIN_DOCS`` per
label): terms that are frequent in toxic and rare in other documents, with
log-odds as weight. Phrases of three words around a term that occur in other
documents (``EXCEPTIONS`` adds fixed ones) take the term's weight back. The
score is a logistic function, fitted to the same sample, of the summed weight
and the weight per word.

Null and empty texts match nothing. Without labels the fixed ``SEEDS`` are the
lexicon. Whole texts are matched; repeated rows score alike. Only id and text
are read, so other columns may have any name.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hireplane.llm import batches as B
from hireplane.llm.samples import lowest

TRAIN_DOCS = 3000  # per label
MOST_TERMS = 5000
LEAST_DOCS = 5
LEAST_LIFT = 10  # that many times as frequent in toxic documents, two standard errors aside
CUT = 0.5
PREFIXES = (4, 5, 6)

#: Fixed start of the lexicon and its exceptions.
SEEDS = ["idiot", "moron", "stupid", "scum", "pathetic", "worthless", "disgusting", "loser"]
EXCEPTIONS = ["idiot proof", "stupid simple", "pathetic fallacy"]

#: Letters of other alphabets that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ո": "n", "ս": "u", "α": "a", "β": "b", "ε": "e", "η": "n",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɡ": "g", "ɑ": "a", "ı": "i",
}
#: Digits and signs that stand for letters.
DIGITS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}

FOLD = {i: " " for i in range(128) if not chr(i).isalnum()}
FOLD |= {ord(k): v for k, v in DIGITS.items()} | {ord("l"): "i"}
FOLD |= {ord(k): v for k, v in LOOKALIKES.items()} | {ord("«"): " ", ord("»"): " ", ord("“"): " ", ord("”"): " ", ord("’"): " ", ord("–"): " ", ord("—"): " ", ord("…"): " ", 0xAD: None, 0x200B: None, 0x200C: None, 0x200D: None}


def fold(text: str) -> str:
    """Folded words between single blanks, a blank at either end."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return " " + " ".join(text.casefold().translate(FOLD).split()) + " "


@dataclass
class Lexicon:
    """Folded terms (a trailing ``*``: word beginning) with weights; exceptions are folded phrases."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    coefficients: tuple[float, float, float] = (-4.0, 2.0, 10.0)

    def __post_init__(self):
        self._machine = None

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "coefficients": self.coefficients, "_machine": None}

    @property
    def machine(self):
        if self._machine is None:
            machine = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                machine.add_word(" " + term[:-1] if term.endswith("*") else f" {term} ", (1, len(term) + (1 if not term.endswith("*") else -1), weight))
            for phrase in self.exceptions:
                machine.add_word(f" {phrase} ", (0, len(phrase) + 1, 0.0))
            machine.make_automaton()
            self._machine = machine
        return self._machine

    def matches(self, folded: str) -> list[tuple[int, float]]:
        """(place of the word, weight): of the terms at one word the heaviest; none inside an exception."""
        if not len(self.machine):
            return []
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (kind, back, weight) in self.machine.iter(folded):
            start = end - back
            if kind:
                if weight > best.get(start, 0.0):
                    best[start] = weight
            else:
                spared.append((start, end))
        if spared and best:
            # For each place where an exception starts, how far those that started up to there reach.
            spared.sort()
            starts, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
            best = {s: w for s, w in best.items() if not (at := bisect_right(starts, s)) or reach[at - 1] <= s}
        return sorted(best.items())

    def measures(self, text: str) -> tuple[float, float]:
        """Summed weight, and weight per word."""
        folded = fold(text)
        found = self.matches(folded)
        if not found:
            return 0.0, 0.0
        total = sum(w for _, w in found)
        return total, total / max(1, folded.count(" ") - 1)

    def probability(self, total: np.ndarray, rate: np.ndarray) -> np.ndarray:
        a, b, c = self.coefficients
        return 1 / (1 + np.exp(-np.clip(a + b * np.log1p(total) + c * np.sqrt(rate), -30, 30)))


def seeds() -> Lexicon:
    return Lexicon({fold(s).strip(): 4.0 for s in SEEDS}, [fold(e).strip() for e in EXCEPTIONS])


def _terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words and word beginnings of each document, with its label; counted before they leave the task."""
    counts: dict[tuple[str, int], int] = {}
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            words = set(fold(text or "").split())
            for term in words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) >= n}:
                counts[term, label] = counts.get((term, label), 0) + 1
    keys = list(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())],
        names=["term", "label", "n"],
    )


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps with a small ridge; both labels weigh the same."""
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + 1e-4 * w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return w


def _contexts(lexicon: Lexicon, folded: str) -> set[str]:
    """Phrases of the words around every match: before it, after it, and both."""
    out = set()
    for start, _ in lexicon.matches(folded):
        before = folded[max(0, start - 40) : start].split()[-1:]
        here, *after = folded[start : start + 80].split()[:2]
        out |= {" ".join(before + [here]), " ".join([here] + after), " ".join(before + [here] + after)} - {here}
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_DOCS) -> Lexicon:
    """Learn terms, weights, exceptions and coefficients; ``labels`` holds only rows that may be learned from."""
    chosen = lowest(labels.select(id_col, label_col).where(F.col(label_col).isNotNull()), id_col, label_col, [0, 1], most)
    # At most 2 * most rows of two numbers.
    picked = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))
    size = {r[0]: r[1] for r in picked.groupBy("label").count().collect()}
    toxic, other = size.get(1, 0), size.get(0, 0)
    if not toxic or not other:
        return seeds()
    sums = picked.mapInArrow(_terms, "term string, label int, n bigint").groupBy("term").agg(
        F.sum(F.expr("IF(label = 1, n, 0)")).alias("bad"), F.sum(F.expr("IF(label = 0, n, 0)")).alias("good"),
    )
    weight = F.log((F.col("bad") + 0.5) / (toxic + 1) / ((F.col("good") + 0.5) / (other + 1)))
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    top = (
        sums.where((F.col("bad") >= LEAST_DOCS) & (weight - 2 * error >= float(np.log(LEAST_LIFT))))
        .select("term", weight.alias("weight"), "bad").orderBy(F.desc("bad"), "term").limit(MOST_TERMS).collect()
    )
    lexicon = Lexicon({r["term"]: float(r["weight"]) for r in top} or seeds().weights, seeds().exceptions)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [lexicon.measures(t) for t in texts]
            contexts = [sorted(_contexts(lexicon, fold(t))) if f[0] else [] for t, f in zip(texts, found)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()), batch.column("label"), pa.array(contexts, pa.list_(pa.string()))],
                names=["total", "rate", "label", "contexts"],
            )

    measured = picked.mapInArrow(measure, "total double, rate double, label int, contexts array<string>")
    rows = sorted(tuple(r) for r in measured.select("total", "rate", "label").collect())
    phrases = measured.select(F.explode("contexts").alias("p"), "label").groupBy("p").agg(
        F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"),
    ).where((F.col("good") >= 2) & (F.col("good") >= 4 * F.col("bad"))).orderBy(F.desc("good"), "p").limit(MOST_TERMS).collect()
    lexicon.exceptions = sorted({*lexicon.exceptions, *(r["p"] for r in phrases)})
    x = np.array([[1.0, np.log1p(t), np.sqrt(r)] for t, r, _ in rows])
    lexicon.coefficients = tuple(float(v) for v in _logistic(x, np.array([r[2] for r in rows], float)))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted (score >= 0.5), weight, weight per word; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for piece in B.pieces(batches, "text"):
            found = np.array([lexicon.measures(t) for t in B.strings(piece.column("text")).to_pylist()]).reshape(-1, 2)
            s = lexicon.probability(found[:, 0], found[:, 1])
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), pa.array(s), pa.array((s >= CUT).astype(np.int32)), pa.array(found[:, 0]), pa.array(found[:, 1])],
                names=["id", "score", "predicted", "weight", "rate"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double, predicted int, weight double, rate double").withColumnRenamed("id", id_col)
