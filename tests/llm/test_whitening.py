"""Whitening against a covariance formed whole in numpy, over many partitions, and on damaged tables."""

import numpy as np
import pytest

from glyphmark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, at string, x double"


def _brute(rows, k=4):
    fit = np.unique(np.floor(256 * np.asarray(rows, np.float32).astype(np.float64)).astype(np.int64), axis=0)
    mean = fit.sum(axis=0) / len(fit)
    values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / len(fit))
    return fit, mean, values[::-1][:k], vectors[:, ::-1][:, :k], values.sum()


@pytest.mark.parametrize("fan", [2, 8])
def test_matches_eigenvectors_of_the_covariance(spark, monkeypatch, fan):
    monkeypatch.setattr(whitening, "FAN", fan)
    monkeypatch.setattr(whitening, "AT_ONCE", 7)
    rng = np.random.default_rng(3)
    rows = (rng.normal(size=(400, 9)) * np.linspace(3, 0.3, 9) + 5).astype(np.float32)
    rows[100:250] = rows[100]
    fit, mean, values, vectors, trace = _brute(rows)
    df = spark.createDataFrame([(k, [float(c) for c in v], 1, "clash", 2.0) for k, v in enumerate(rows)], SCHEMA).repartition(13)
    out, fitted = whitening.whiten(df)
    assert fitted.n == len(fit) == 251 and fitted.sums == tuple(fit.sum(axis=0).tolist())
    assert np.allclose(fitted.values, values, rtol=1e-12) and np.isclose(fitted.trace, trace, rtol=1e-12)
    assert np.allclose(np.abs((fitted.vectors * vectors).sum(axis=0)), 1, atol=1e-12) and fitted.identity_error < 1e-10
    got = {r.vec_id: r for r in out.collect()}
    x = np.floor(256 * rows.astype(np.float64))
    want = (x - mean) @ vectors / np.sqrt(values)
    mine = np.array([got[k].whitened for k in range(400)])
    assert np.allclose(mine * np.sign((mine * want).sum(axis=0)), want, atol=1e-9)
    assert [got[k].deviation for k in range(400)] == [sum((fitted.n * int(a) - s) ** 2 for a, s in zip(v, fitted.sums, strict=True)) for v in x]


def test_nulls_lengths_ties_and_repeats(spark):
    rows = [(1, [0.5, -0.25]), (1, [0.5, -0.25]), (None, [0.0, 1.0]), (2, None), (3, []), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1e38, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [-0.001, 0.0])]
    out, fitted = whitening.whiten(spark.createDataFrame([(*r, 1, "a", 0.0) for r in rows], SCHEMA))
    assert sorted(r.vec_id or 0 for r in out.collect()) == [0, 1, 1, 9] and fitted.n == 3 and fitted.sums == (127, 192)
    out, fitted = whitening.whiten(spark.createDataFrame([(1, [2.0, 4.0], 1, "a", 0.0)] * 3, SCHEMA))
    assert [(r.deviation, r.whitened) for r in out.collect()] == [(0, [None, None])] * 3 and fitted.identity_error is None
    line, fitted = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 1.0], 1, "a", 0.0) for k in range(5)], SCHEMA))
    assert {tuple(w is None for w in r.whitened) for r in line.collect()} == {(False, True, True)} and fitted.identity_error < 1e-12
    out, fitted = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert fitted is None and out.count() == 0


def test_deviation_near_the_end_of_a_long():
    x, sums = np.array([[3_037_000_499, 0], [3_037_000_500, 0], [0, 7]]), (0, 0)
    assert whitening.deviations(x, 1, sums) == [3_037_000_499**2, None, 49]


def test_query_has_each_component(spark):
    rows = whitening.op11_embedding_whitening(spark, "/root/testdata/sf0.001").collect()
    source = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert len(rows) == 4 * source.count() and {r.component for r in rows} == {1, 2, 3, 4}
    assert all(0 < r.explained < 1 and r.identity_error < 1e-4 for r in rows)
