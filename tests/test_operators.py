"""Operators that fold in order, against plain versions; golden values of text functions."""

from __future__ import annotations

import hashlib
import hmac

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hippolake.functions import text as T
from hippolake.functions import vectors as V
from hippolake.operators import graph, knowledge, retrieval, sessions, store, telemetry


def cos(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    n = np.sqrt(a @ a) * np.sqrt(b @ b)
    return float(a @ b / n) if len(a) == len(b) and n else 0.0


def test_text_functions(spark):
    row = spark.createDataFrame([("  Hello\tWORLD  é ", "a1_b2 <br/>x&amp;lt; <b>y</b>")], "t string, h string").select(
        T.tokens(F.col("t")).alias("tokens"), T.normalise(F.col("t")).alias("norm"), T.hmac_sha256(b"key", F.col("t")).alias("mac"), T.strip_html(F.col("h")).alias("html"), T.fnv1a(F.lit("abc")).alias("fnv"), T.strip_fences(F.lit('```json\n{"a":1}\n```')).alias("fence")
    ).first()
    assert row.tokens == ["hello", "world", "é"] and row.norm == "hello world é"
    assert row.mac == hmac.new(b"key", "  Hello\tWORLD  é ".encode(), hashlib.sha256).hexdigest()
    assert row.html == "a1_b2 \nx< y" and row.fnv == "1a47e90b" and row.fence == '{"a":1}'


def test_cosine_edges(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([], []), (None, [1.0]), ([0.0], [1.0]), ([1.0], [1.0, 2.0])]
    got = [r.c for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<double>, b array<double>").orderBy("i").select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert [round(x, 9) for x in got] == [round(2**-0.5, 9), 0.0, 0.0, 0.0, 0.0]


def test_mmr_matches_a_plain_loop(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(12, 4))
    df = spark.createDataFrame([(1, i, i + 1, vectors[i].tolist()) for i in range(12)], "query_id long, id long, position long, embedding array<double>")
    got = [r.id for r in retrieval.mmr(df, k=5).orderBy("pick").collect()]
    left, picked = list(range(12)), []
    while len(picked) < 5:
        best = max(left, key=lambda i: (0.7 * (1 - i / 12) - 0.3 * max([0.0, *(cos(vectors[i], vectors[j]) for j in picked)]), -i))
        picked.append(best)
        left.remove(best)
    assert got == picked


def test_greedy_clusters_compare_with_first_members(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(i, i % 2, vectors[i].tolist()) for i in range(40)], "id long, block int, embedding array<double>")
    got = {r.id: (r.block, r.cluster) for r in knowledge.greedy_clusters(df, 0.8, block="block").collect()}
    for block in (0, 1):
        leaders = []
        for i in range(block, 40, 2):
            hit = next((k for k, j in enumerate(leaders) if cos(vectors[i], vectors[j]) >= 0.8), None)
            if hit is None:
                leaders.append(i)
                hit = len(leaders) - 1
            assert got[i] == (block, hit)


def test_in_batch_dedup(spark):
    rows = [(1, 0, "ADD", [1.0, 0.0]), (2, 0, "ADD", [1.0, 0.01]), (3, 0, "UPDATE", [1.0, 0.0]), (4, 0, "ADD", None), (5, 0, "ADD", [0.0, 1.0]), (6, 1, "ADD", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, batch int, action string, embedding array<double>")
    assert {r.id for r in knowledge.in_batch_dedup(df, 0.85, batch="batch").filter("kept").collect()} == {1, 3, 4, 5, 6}


def test_semantic_sessions(spark):
    rows = [(1, 0, 0.0, [1.0, 0.0]), (1, 1, 1800.0, [0.9, 0.1]), (1, 2, 3601.0, [1.0, 0.0]), (1, 3, None, [0.0, 1.0]), (1, 4, 9999.0, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, at double, embedding array<double>")
    assert [r.session for r in sessions.semantic_sessions(df).orderBy("turn").collect()] == [0, 0, 1, 2, 2]


def test_rate_limit_ignores_denied_hits(spark):
    df = spark.createDataFrame([(1, i, at) for i, at in enumerate([0, 1, 2, 3, 11, 12, 13])], "user long, id long, at long")
    got = {r.id: r.allowed for r in telemetry.rate_limit(df, key="user", order=["at", "id"], at="at", most=2, window=10).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 6: False}


def test_sequence_and_chains(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") * 7919 % 500).alias("at"))
    got = {r.id: r.seq for r in store.sequence(df, ["at", "id"], spread=7).collect()}
    assert sorted(got.values()) == list(range(1, 501)) and all(got[i] == i * 7919 % 500 + 1 for i in range(500))
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101), (101, 100)], "id long, next long")
    out = {r.id: (r.root, r.depth) for r in graph.chains(links, most_steps=8).collect()}
    assert out == {i: (0, i) for i in range(21)}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 9), min_size=1, max_size=12))
def test_batches_fit_and_keep_order(spark, sizes):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(sizes)], "k long, i long, n long")
    rows = sorted((r.i, r.batch, r.n) for r in store.batches(df, key="k", order="i", size="n", most_rows=3, most_bytes=10).collect())
    assert [r[0] for r in rows] == list(range(len(sizes))) and [r[1] for r in rows] == sorted(r[1] for r in rows)
    for b in {r[1] for r in rows}:
        held = [n for _, x, n in rows if x == b]
        assert len(held) <= 3 and sum(held) <= 10
