"""Whitening against numpy's own eigenvectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hireplane.llm import queries, whitening

ROWS = "vec_id bigint, embedding array<double>"


def made(n=300, d=24, seed=2):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, d)) @ rng.standard_normal((d, d))


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(vectors)], ROWS).repartition(3)


def plain(vectors):
    x = np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    z = fit - sums / n
    covariance = z.T @ z / n
    values, found = np.linalg.eigh(covariance)
    return x, n, sums, covariance, values[::-1], found[:, ::-1]


def test_equals_numpy(spark):
    vectors = made()
    vectors = np.concatenate([vectors, vectors[:40], np.repeat(vectors[:1], 200, 0)])
    df = frame(spark, vectors)
    model = whitening.fit(df)
    got = {r.vec_id: r for r in whitening.whiten(df, model).collect()}
    x, n, sums, covariance, values, found = plain(vectors)
    assert len(got) == len(vectors) and model.center.n == n == 300
    assert np.allclose(model.values, values[:16], rtol=1e-12)
    assert model.identity_error < 1e-9
    for k in range(16):
        sign = np.sign(model.vectors[:, k] @ found[:, k])
        white = (x - sums / n) @ found[:, k] / math.sqrt(values[k]) * sign
        assert np.allclose([got[i].whitened[k] for i in range(len(vectors))], white, atol=1e-7)
    for i, r in got.items():
        assert int(r.deviation) == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums))
        assert np.allclose(r.explained, values[:16] / np.trace(covariance)) and r.identity_error == model.identity_error


def test_rows_without_a_whole_vector_are_dropped(spark):
    vectors = [*made(20, 3).tolist(), None, [], [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [0.0, float("inf"), 0.0]]
    df = frame(spark, vectors)
    rows = whitening.whiten(df, whitening.fit(df)).collect()
    assert sorted(r.vec_id for r in rows) == list(range(20)) and all(len(r.whitened) == 3 for r in rows)


def test_tables_without_spread(spark):
    for vectors in ([], [None], [[]], [[1.0, 2.0]], [[1.0, 2.0]] * 5):
        df = frame(spark, vectors)
        rows = whitening.whiten(df, whitening.fit(df)).collect()
        assert all(r.whitened == [] and r.explained == [] for r in rows)
        assert len(rows) == sum(bool(v) for v in vectors)


def test_one_direction_only(spark):
    df = frame(spark, [[float(i), 2.0 * i, -i] for i in range(9)])
    model = whitening.fit(df)
    rows = whitening.whiten(df, model).collect()
    assert {len(r.whitened) for r in rows} == {1} and math.isclose(rows[0].explained[0], 1.0)
    assert math.isclose(sum(r.whitened[0] ** 2 for r in rows) / 9, 1.0)


def test_other_lengths_are_an_error(spark):
    df = frame(spark, [[1.0, 2.0], [1.0, 2.0, 3.0]])
    with pytest.raises(Exception, match="entries where all have"):
        whitening.fit(df)


def test_null_ids_clashing_columns_and_huge_entries(spark):
    vectors = made(12, 4).tolist()
    rows = [(None if i % 2 else i, v, "mine") for i, v in enumerate([*vectors, [1e300, -1e300, 0.0, 1.0]])]
    df = spark.createDataFrame(rows, ROWS + ", x string").withColumns({c: F.lit(1) for c in ("id", "vector", "n", "whitened")})
    out = whitening.whiten(df, whitening.fit(df)).collect()
    assert len(out) == 13 and sum(r.vec_id is None for r in out) == 6
    exact = [r for r in out if r.deviation is not None]
    assert len(exact) == 13 and max(int(r.deviation) for r in exact) > 2**63


@pytest.mark.parametrize("name", ["identity", "pairs", "blocks", "wilkinson", "falling", "one", "negative"])
def test_leading_on_hard_matrices(name):
    rng = np.random.default_rng(1)
    basis = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    half = (lambda m: m.T @ m)(rng.standard_normal((30, 20)))
    wilkinson = np.diag(np.abs(np.arange(40) - 19.5)) + np.diag(np.ones(39), 1) + np.diag(np.ones(39), -1)
    a = {
        "identity": np.eye(40), "pairs": (basis * np.repeat(np.arange(20) + 1.0, 2)) @ basis.T,
        "blocks": np.block([[half, np.zeros((20, 20))], [np.zeros((20, 20)), half]]), "wilkinson": wilkinson,
        "falling": (basis * 10.0 ** -np.arange(40)) @ basis.T, "one": np.ones((40, 40)), "negative": -np.eye(40),
    }[name]
    a = (a + a.T) / 2
    values, vectors = whitening.leading(a, 16)
    size = np.abs(a).max()
    right = np.linalg.eigvalsh(a)[::-1][:16]
    assert len(values) == (right > whitening.FLAT * max(right[0], 0)).sum()
    assert np.allclose(values, right[: len(values)], atol=1e-13 * 40 * size)
    assert np.abs(a @ vectors - vectors * values).max(initial=0) < 1e-12 * size * 40
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) < 1e-12


def test_sturm_counts(spark):
    rng = np.random.default_rng(7)
    diagonal, beside = rng.standard_normal(12), rng.standard_normal(11)
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1))
    at = np.linspace(values[0] - 1, values[-1] + 1, 101)
    assert (whitening.sturm_count(diagonal, beside, at, 1e-300) == [(values < x).sum() for x in at]).all()


def test_query_rows(spark, tmp_path):
    vectors = made(60, 20)
    frame(spark, vectors).write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = queries.op12_whitening(spark, str(tmp_path)).collect()
    assert sorted((r.vec_id, r.component) for r in rows) == [(i, k) for i in range(60) for k in range(1, 17)]
    shares = {r.component: r.explained for r in rows}
    assert sorted(shares.values(), reverse=True) == [shares[k] for k in range(1, 17)]
