"""Whitening of embeddings: the leading principal components, each scaled to variance 1.

Entries become integers, x = floor(64 c) + 1000000, so equality, sums and
deviations are exact. The fit list is every distinct integer vector once. Sums
and then the centred covariance are added up in the tasks and, per cell, by
Spark; the driver gets one square matrix, whose size is that of a vector and
does not grow with the rows. There it is brought to tridiagonal form by
Householder reflections, the leading eigenvalues are found by bisection on Sturm
counts, their vectors by inverse iteration with the vectors of one cluster kept
orthogonal, and both go back to the rows as a broadcast projection.

Rows whose vector is null, empty, or holds a null or non-finite entry are
dropped. Null ids and repeated rows stay; equal vectors count once in the fit.
All vectors must have one length, another one is an error. Entries beyond
``MOST_ENTRY`` in size count as that. Components are those with an eigenvalue
above rounding (``FLAT`` times the largest), so equal vectors, a single one and
an empty table have none. Other columns are not looked at.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hireplane.llm.components import stored
from hireplane.llm.rowkeys import kind_of

SCALE, SHIFT = 64, 1_000_000
MOST_ENTRY = float(1 << 44)
MOST_DIMENSIONS = 2048
COMPONENTS = 16
FLAT = 1e-11
#: Sums are kept in two halves that no number of rows overflows.
HALF = 26


# --- rows --------------------------------------------------------------------

def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("vector").cast(pa.large_list(pa.float64()))
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        values = pc.fill_null(column.flatten(), float("nan")).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        bad = np.bincount(owner, weights=~np.isfinite(values), minlength=len(sizes)) > 0
        good = (sizes > 0) & ~bad
        with np.errstate(invalid="ignore"):
            x = (np.floor(SCALE * np.clip(values, -MOST_ENTRY, MOST_ENTRY))[good[owner]]).astype(np.int64) + SHIFT
        ends = np.concatenate([[0], np.cumsum(8 * sizes[good])]).astype(np.int64)
        packed = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(x.astype("<i8").tobytes())],
        )
        ids = batch.column("id").filter(pa.array(good))
        yield pa.RecordBatch.from_arrays([ids, packed.cast(pa.binary())], names=["id", "x"])


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id`` and ``x``: the integer vector as little-endian 64-bit numbers, of rows with a whole vector."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    return rows.mapInArrow(_integers, f"id {kind_of(rows, 'id')}, x binary")


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    column = batch.column("x").cast(pa.large_binary())
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    if (sizes != 8 * width).any():
        raise ValueError(f"vectors of {sizes.min() // 8} to {sizes.max() // 8} entries where all have {width}")
    _, offsets, data = column.buffers()
    start = np.frombuffer(offsets, np.int64)[column.offset]
    return np.frombuffer(data, "<i8", count=len(column) * width, offset=start).reshape(-1, width)


# --- sums over the fit list --------------------------------------------------

def _sums(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            x = _matrix(batch, width)
            n, high, low = n + len(x), high + (x >> HALF).sum(0), low + (x & ((1 << HALF) - 1)).sum(0)
        if n:
            yield pa.RecordBatch.from_pydict({"i": np.arange(width), "n": np.full(width, n), "high": high, "low": low})

    return run


def _products(center, transform):
    """Per task the sum of the outer products of ``transform``ed centred rows, cell by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            z = transform(center.rows(batch))
            total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_pydict({"i": i, "j": j, "v": total[i, j]})

    return run


@dataclass
class Center:
    """n, the whole part of each mean and what is left of the sums beyond n times it."""

    n: int
    whole: np.ndarray
    left: np.ndarray

    def rows(self, batch: pa.RecordBatch) -> np.ndarray:
        """Centred rows: small whole numbers first, then the fraction, so nothing is lost to the size of x."""
        return (_matrix(batch, len(self.whole)) - self.whole).astype(np.float64) - self.left / self.n


@dataclass
class Whitening:
    center: Center
    values: np.ndarray
    #: Columns are unit eigenvectors.
    vectors: np.ndarray
    trace: float
    identity_error: float


def _square(fit_list: DataFrame, center: Center, transform, size: int) -> np.ndarray:
    parts = fit_list.mapInArrow(_products(center, transform), "i bigint, j bigint, v double")
    out = np.zeros((size, size))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out / center.n


def fit(
    vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding",
) -> Whitening | None:
    """Leading components of the fit list; None for a table without a whole vector."""
    x = integer_vectors(vectors, id_col, vector_col).select("x")
    fit_list = stored(x.distinct(), "fit-list")
    longest = fit_list.agg(F.max(F.octet_length("x"))).first()[0]
    if longest is None:
        return None
    width = longest // 8
    if width > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {width} entries; the driver takes matrices of up to {MOST_DIMENSIONS}")
    sums = fit_list.mapInArrow(_sums(width), "i bigint, n bigint, high bigint, low bigint").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"),
    ).orderBy("i").collect()
    n = sums[0].n
    totals = [(r.high << HALF) + r.low for r in sums]
    center = Center(n, np.array([t // n for t in totals]), np.array([t % n for t in totals]))
    covariance = _square(fit_list, center, lambda z: z, width)
    values, found = leading(covariance, min(components, width))
    trace = float(np.trace(covariance))
    error = 0.0
    if len(values):
        scaled = found / np.sqrt(values)
        whitened = _square(fit_list, center, lambda z: z @ scaled, len(values))
        error = float(np.abs(whitened - np.eye(len(values))).max())
    return Whitening(center, values, found, trace, error)


# --- eigenvectors of one symmetric matrix ------------------------------------

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, beside, reflections) with a = Q T Q', Q the product of the Householder reflections in order."""
    a, n = a.copy(), len(a)
    reflections = []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size > 0:
            v[0] += size if v[0] >= 0 else -size
            length = np.linalg.norm(v)
            v = v / length if length > 0 else v
        if size > 0:
            p = a[k:, k + 1 :] @ v
            a[k:, k + 1 :] -= 2 * np.outer(p, v)
            p = v @ a[k + 1 :, k:]
            a[k + 1 :, k:] -= 2 * np.outer(v, p)
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def sturm_count(diagonal: np.ndarray, beside: np.ndarray, x: np.ndarray, tiny: float) -> np.ndarray:
    """How many eigenvalues lie below each x: negative terms of the sequence of pivots of T - x."""
    count, q = np.zeros(len(x), np.int64), np.ones(len(x))
    squares = np.concatenate([[0.0], beside**2])
    for d, e2 in zip(diagonal, squares):
        q = d - x - e2 / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def bisected(diagonal: np.ndarray, beside: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each as closely as doubles tell."""
    n = len(diagonal)
    reach = np.concatenate([[0.0], np.abs(beside)]) + np.concatenate([np.abs(beside), [0.0]])
    low = np.full(k, (diagonal - reach).min())
    high = np.full(k, (diagonal + reach).max())
    size = max(abs(low[0]), abs(high[0]), np.finfo(float).tiny)
    low, high = low - 1e-12 * size, high + 1e-12 * size
    wanted = n - np.arange(k)  # eigenvalues up to and with the wanted one
    for _ in range(120):
        middle = (low + high) / 2
        above = sturm_count(diagonal, beside, middle, 1e-300 + np.finfo(float).eps ** 2 * size) >= wanted
        low, high = np.where(above, low, middle), np.where(above, middle, high)
        if (high - low <= 2 * np.finfo(float).eps * np.maximum(np.abs(low), np.abs(high))).all():
            break
    return (low + high) / 2


def _solver(diagonal: np.ndarray, beside: np.ndarray, shift: float, tiny: float):
    """T - shift factored with row exchanges; a function that solves for one right side."""
    n = len(diagonal)
    d, up, up2 = (diagonal - shift).tolist(), [*beside.tolist(), 0.0], [0.0] * n
    steps = []
    for i in range(n - 1):
        below, nxt, after = float(beside[i]), d[i + 1], up[i + 1]
        if abs(d[i]) >= abs(below):
            pivot = d[i] if abs(d[i]) > tiny else tiny
            d[i] = pivot
            m = below / pivot
            d[i + 1] = nxt - m * up[i]
            steps.append((False, m))
        else:
            m = d[i] / below
            d[i], up_i = below, up[i]
            up[i], up2[i] = nxt, after
            d[i + 1], up[i + 1] = up_i - m * nxt, -m * after
            steps.append((True, m))
    if abs(d[-1]) <= tiny:
        d[-1] = tiny

    def solve(right: np.ndarray) -> np.ndarray:
        b = right.tolist()
        for i, (swapped, m) in enumerate(steps):
            if swapped:
                b[i], b[i + 1] = b[i + 1], b[i]
            b[i + 1] -= m * b[i]
        for i in range(n - 1, -1, -1):
            rest = b[i]
            if i + 1 < n:
                rest -= up[i] * b[i + 1]
            if i + 2 < n:
                rest -= up2[i] * b[i + 2]
            b[i] = rest / d[i]
        return np.array(b)

    return solve


def inverse_iteration(diagonal: np.ndarray, beside: np.ndarray, values: np.ndarray, steps: int = 5) -> np.ndarray:
    """Unit eigenvectors as columns; those of eigenvalues that lie close are kept orthogonal in every step."""
    n = len(diagonal)
    size = max(np.abs(diagonal).max(), np.abs(beside).max() if n > 1 else 0.0, np.finfo(float).tiny)
    eps = np.finfo(float).eps
    out, start, shift = np.zeros((n, len(values))), 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * size:
            start, shift = k, np.inf
        # Equal values get shifts that differ a little, so that they give different vectors.
        shift = min(value, shift - 10 * eps * size)
        solve = _solver(diagonal, beside, shift, eps * size)
        v = np.random.default_rng(k).standard_normal(n)
        cluster = out[:, start:k]
        for _ in range(steps):
            for _ in range(2):
                v = v - cluster @ (cluster.T @ v)
            v = solve(v / np.linalg.norm(v))
            v = v / np.linalg.norm(v)
        for _ in range(2):
            v = v - cluster @ (cluster.T @ v)
        out[:, k] = v / np.linalg.norm(v)
    return out


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the k largest eigenvalues above rounding, falling; vectors are unit columns."""
    size = np.abs(matrix).max() if matrix.size else 0.0
    if k == 0 or not size > 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    a = matrix / size
    diagonal, beside, reflections = tridiagonal(a)
    values = bisected(diagonal, beside, k)
    # Values are known up to rounding; what may be above the limit counts.
    rounding = len(a) * np.finfo(float).eps
    values = values[values > (FLAT - rounding) * max(values[0], 0.0)]
    vectors = inverse_iteration(diagonal, beside, values)
    for i in range(len(reflections) - 1, -1, -1):
        v = reflections[i]
        vectors[i + 1 :] -= 2 * np.outer(v, v @ vectors[i + 1 :])
    vectors /= np.linalg.norm(vectors, axis=0)
    # The quotient is as good as the vector is, squared.
    values = np.einsum("ik,ij,jk->k", vectors, a, vectors, optimize=True)
    order = np.argsort(-values, kind="stable")
    return values[order] * size, vectors[:, order]


# --- projection --------------------------------------------------------------

def _deviations(y: np.ndarray, center: Center) -> pa.Array:
    """Exact sums over the entries of (n x - S)^2, as numbers of up to 38 digits; null beyond."""
    kind = pa.decimal128(38, 0)
    reach = float(center.n) * (float(np.abs(y).max()) + 1) if y.size else 0.0
    if reach < 3e9 and reach * reach * y.shape[1] < 9e18:
        t = center.n * y - center.left
        return pa.array((t * t).sum(1)).cast(kind)
    n, left = center.n, center.left.tolist()
    sums = [sum((n * v - s) ** 2 for v, s in zip(row, left)) for row in y.tolist()]
    return pa.array([decimal.Decimal(s) if s < 10**38 else None for s in sums], kind)


def _projector(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Whitening = shared.value
        center, scaled = model.center, model.vectors / np.sqrt(model.values)
        for batch in batches:
            y = _matrix(batch, len(center.whole)) - center.whole
            white = (y.astype(np.float64) - center.left / center.n) @ scaled
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1]), pa.array(white.ravel()),
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), _deviations(y, center), lists], names=["id", "deviation", "whitened"],
            )

    return run


def whiten(
    vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row per whole vector: its id, ``n``, ``deviation``, ``whitened`` and ``explained`` by component, ``identity_error``."""
    spark = vectors.sparkSession
    kind = kind_of(vectors, id_col)
    if model is None:
        schema = f"id {kind}, n bigint, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    rows = integer_vectors(vectors, id_col, vector_col)
    shared = spark.sparkContext.broadcast(model)
    out = rows.mapInArrow(_projector(shared), f"id {kind}, deviation decimal(38,0), whitened array<double>")
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values]).cast("array<double>")
    return out.select(
        F.col("id").alias(id_col), F.lit(model.center.n).cast("bigint").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
