"""Hyperplane buckets: published values, pairs against brute force, hot groups."""

from __future__ import annotations

import math

import numpy as np
import pytest

from hippolake.functions import lsh

# Planes and bucket digests that every implementation must give for this secret.
SECRET = bytes.fromhex("6f8b0d095090ecc480130490337485290344eed21235a4d5add0b3870bb0dcd8")
SMALL_PLANES = [
    0.2793121433396607, 0.12404430380721115, 0.9232998413063636, 0.10207562509607696, 0.08564770563810467, -1.0188010601466846, -0.6339878477568374, -0.184417346427592,
    -1.68295069499376, 1.2739158639311443, -0.2584514628452298, -0.3093903181581613, -0.3464622813391981, 1.6825832310544853, -2.2472164110762627, 0.059148279247496105,
]
SMALL_VECTOR = [0.5, -0.3, 0.8, -0.1]
SMALL_HASHES = [
    "463bd7eb9a4b013688cca0406913759561c03ad9f2c7e5ce2593ec2b9725c160",
    "be23e5f6a72e8c9e1671ee4e5052a5b85490c907e7dd3c1810ace1b17dcc4137",
    "a418d6f3cf46311f9187fd91fe0736c2eeac647043406d22e952ceb5e7f9ebdc",
]
LONG_HASHES = [
    "fd3080455f40326ba4c69b372fbeebfa0468257ba5d2d623ff5ae1b9745e8053",
    "95ab08801bdefa5597ea9427cf6de667fb5e74fe45090da11d5c92d7931d34c5",
    "83371eb81d27f9ddcf7f4dcd96187535196b677cf4866acd5fb848bae8ef1ff0",
]


def hashes(spark, vector, tables, bits):
    df = spark.createDataFrame([(1, vector)], "id long, v array<double>")
    return df.select(lsh.bucket_hashes(lsh.signature(df.v, SECRET, len(vector), tables, bits), bits)).first()[0]


def test_published_values(spark):
    assert np.allclose(lsh.planes(SECRET, 4, 3, 4)[0].ravel(), SMALL_PLANES, rtol=1e-12)
    assert hashes(spark, SMALL_VECTOR, 3, 4) == SMALL_HASHES
    assert hashes(spark, [math.sin(i * 0.1) * 0.5 for i in range(1024)], 20, 32)[:3] == LONG_HASHES


def test_short_secrets_and_sizes():
    for args in ((b"short", 4), (SECRET, 0), (SECRET, 4, 0), (SECRET, 4, 1, 0)):
        with pytest.raises(ValueError):
            lsh.planes(*args)


def test_vectors_that_do_not_fit(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, []), (6, [0.0, 0.0])], "id long, v array<double>")
    found = {r.id: r.s for r in df.select("id", lsh.signature(df.v, SECRET, 2, 3, 8).alias("s")).collect()}
    assert [found[i] for i in (2, 3, 4, 5)] == [None] * 4 and len(found[1]) == 3 and found[6] == [255] * 3
    assert lsh.near_pairs(df.withColumnRenamed("v", "embedding"), 0.5, SECRET, 2).count() == 0


def test_pairs_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, (60, 16))
    vectors = np.concatenate([base, base + rng.normal(0, 0.05, base.shape), np.repeat(base[:1], 200, axis=0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<double>")
    found = {(r.a, r.b): r for r in lsh.near_pairs(df, 0.9, SECRET, 16).collect()}
    unit = vectors[:120] / np.linalg.norm(vectors[:120], axis=1)[:, None]
    wanted = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.9, 1)), strict=True)}
    signed = (vectors[:120] @ lsh.planes(SECRET, 16).reshape(640, 16).T >= 0).reshape(120, 20, 32)
    reachable = {(i, j): int((signed[i] == signed[j]).all(axis=1).sum()) for i, j in wanted}
    assert {p: r.n_tables for p, r in found.items()} == {p: n for p, n in reachable.items() if n}
    assert len(found) >= 0.9 * len(wanted) and all(abs(r.cosine - unit[p[0]] @ unit[p[1]]) < 1e-9 for p, r in found.items())
