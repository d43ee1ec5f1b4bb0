"""Whitening against a dense eigensolver."""

from __future__ import annotations

import numpy as np
import pytest

from hippolake.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int, x string, n int, whitened double"


def frame(spark, vectors, ids=None):
    rows = [(i, v, 1, "x", 2, 0.5) for i, v in zip(ids or range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def run(spark, vectors, k=16, ids=None):
    rows = whitening.to_integers(frame(spark, vectors, ids))
    return whitening.transform(rows, whitening.fit(rows, k)).collect()


def plain(vectors, k):
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1][:k], vecs[:, ::-1][:, :k]
    t = n * np.array(x, np.int64) - sums
    return n, (t * t).sum(axis=1), (t / n) @ vecs / np.sqrt(values), values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize(("rows", "dims", "k"), [(400, 20, 16), (300, 5, 16), (900, 200, 16), (200, 64, 3)])
def test_against_a_dense_solver(spark, rows, dims, k):
    rng = np.random.default_rng(rows)
    made = rng.normal(0, 1, (rows, dims)) @ np.diag(1.0 + 3.0 / (1 + np.arange(dims))) @ np.linalg.qr(rng.normal(0, 1, (dims, dims)))[0]
    vectors = made.tolist() + made[:50].tolist()
    found = {(r.vec_id, r.component): r for r in run(spark, vectors, k)}
    n, deviations, white, explained = plain(vectors, k)
    assert len(found) == len(vectors) * white.shape[1] and n == rows
    got = np.array([[found[i, c + 1].whitened for c in range(white.shape[1])] for i in range(len(vectors))])
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got * signs - white).max() < 1e-6
    for (i, c), r in found.items():
        assert r.n == n and r.deviation == deviations[i] and r.identity_error < 1e-9 and abs(r.explained / explained[c - 1] - 1) < 1e-9


def test_rows_that_take_no_part_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [-1.0, 0.0, 0.5], [0.0, -1.0, 0.0]]
    vectors = good + [good[0], None, [1.0, None, 0.0], [nan, 0.0, 0.0], [0.0, inf, 0.0], [1.0, 2.0], [], [0.015, 0.0, -0.001]]
    ids = [1, 2, 3, 4, 1, 6, 7, 8, 9, 10, 11, None]
    found = run(spark, vectors, ids=ids)
    assert sorted({r.vec_id for r in found}, key=lambda i: (i is None, i)) == [1, 2, 3, 4, None] and len(found) == 6 * 3
    assert {r.n for r in found} == {5} and len({(r.component, r.whitened) for r in found if r.vec_id == 1}) == 3


def test_few_directions(spark):
    assert run(spark, []) == [] and run(spark, [[]]) == [] and run(spark, [[0.5, 0.5]] * 4) == []
    line = run(spark, [[float(i), 2.0 * i, 0.0] for i in range(10)])
    assert {r.component for r in line} == {1} and line[0].explained == pytest.approx(1.0) and line[0].identity_error < 1e-9


def test_entries_beyond_longs(spark):
    vectors = [[1e300, 1.0], [-1e300, 2.0], [1e15, 3.0], [0.0, 4.0]]
    found = run(spark, vectors)
    assert {r.deviation for r in found} == {None} and {r.component for r in found} == {1}


def test_the_solver_on_a_flat_spectrum():
    rng = np.random.default_rng(3)
    rows = rng.normal(0, 1, (3000, 400))
    v = rows.T @ rows / len(rows)
    values, vectors = whitening.lobpcg(lambda b: v @ b, 400, 16)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:16], rtol=1e-10)
    assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() < 1e-9 * values[0]
