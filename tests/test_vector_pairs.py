"""Vector pairs against brute force."""

from __future__ import annotations

import numpy as np

from pyspark.sql import functions as F

from hippolake.functions import vectors as V
from hippolake.plans import retrieval  # noqa: F401  (registers the query)
from hippolake.plans.catalog import QUERIES


def brute(ids, x, least):
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(n @ n.T, 1) >= least)
    return {(min(ids[a], ids[b]), max(ids[a], ids[b])) for a, b in zip(i, j, strict=True)}


def test_recall_of_the_query(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    all_pairs = brute([r.vec_id for r in rows], np.array([r.embedding for r in rows], float), 0.35)
    found = {(r.a, r.b) for r in QUERIES["J4_cosine_pairs"](spark, small).collect()}
    assert len(found & all_pairs) >= 0.9 * len(all_pairs) > 100
    assert found == all_pairs


def test_pairs_across_blocks(spark, monkeypatch):
    x = np.random.default_rng(5).standard_normal((150, 16)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(200, None), (201, []), (202, [0.0] * 16), (203, [1.0, 2.0]), (204, [2.0, 4.0]), (None, x[0].tolist())]
    monkeypatch.setattr(V, "BLOCK_ROWS", 40)
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    found = [(r.a, r.b) for r in V.cosine_pairs(df, 0.35, id_col="vec_id", vector_col="embedding").collect()]
    assert len(found) == len(set(found)) and set(found) == brute(list(range(150)), x, 0.35) | {(203, 204)}


def test_pairs_of_blocks_in_parts(spark, monkeypatch):
    """Blocks of many rows, of few, of one and without name; parts of several sizes give the same pairs."""
    rng = np.random.default_rng(6)
    rows = [(i, ["big", "big", "big", "small", None][i % 5] if i % 17 else f"own{i}", rng.normal(size=4).tolist()) for i in range(300)] + [(400, "big", None), (None, "big", [1.0, 0.0, 0.0, 0.0]), (401, "big", [0.0] * 4), (402, "big", [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, entity string, v array<double>")
    whole = [(i, e, np.array(v) / np.linalg.norm(v)) for i, e, v in rows if i is not None and e and v and any(v) and len(v) == 4]
    expected = {(a[0], b[0], a[1]) for a in whole for b in whole if a[0] < b[0] and a[1] == b[1] and a[2] @ b[2] >= 0.6}
    for size in (1024, 16):
        monkeypatch.setattr(V, "BLOCK_ROWS", size)
        found = [(r.a, r.b, r.entity) for r in V.cosine_pairs(df, 0.6, id_col="id", vector_col="v", block="entity").collect()]
        assert len(found) == len(set(found)) and set(found) == expected


def test_hamming(spark):
    one, other = 0b1011001, 0b11
    distance = spark.range(1).select(V.hamming(F.lit(one), F.lit(other)).alias("d"), V.hamming_similarity(F.lit(5), 10).alias("s")).first()
    assert distance.d == (one ^ other).bit_count() and abs(distance.s) < 1e-12


def test_hits_of_queries(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 16)
    x = np.random.default_rng(8).standard_normal((300, 4)).round(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 4)], "id long, embedding array<double>")
    pairs = brute(list(range(300)), x, 0.9)
    found = [(r.query_id, r.id) for r in V.cosine_hits(df.filter("id % 5 = 0"), df, 0.9).collect()]
    assert len(found) == len(set(found)) and set(found) == {(a, b) for p in pairs for a, b in (p, p[::-1]) if a % 5 == 0}
