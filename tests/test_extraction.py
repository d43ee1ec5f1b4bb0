"""Entities, envelopes, vectors as text and ids: handmade cases."""

from __future__ import annotations

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from hippolake.functions import embedding
from hippolake.plans import extraction


def test_query_entities(spark):
    cases = {
        "Where did Anna Maria Lopez meet Bob?": ["anna maria lopez", "anna", "maria", "lopez", "bob"],
        "What is the VPN for my GPS on March 3, 2024? Sure.": ["gps", "vpn", "march", "march 3, 2024"],
        "see 2024/1/5. Then Michael's NASA talk": ["then michael", "michaels", "nasa", "2024/1/5"],
        "": [], "   ": [], "ÄNASA NASAÄ Élan": [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "text string").withColumn("e", extraction.query_entities(F.col("text")))
    for r in df.collect():
        assert sorted(r.e) == sorted(set(cases[r.text])), r.text


def test_envelopes(spark):
    rows = [(0, 'say "hi" {x}'), (1, "plain"), (2, '{"other": 1}'), (3, "not json {"), (4, '{"t": 5, "a"')]
    df = spark.createDataFrame(rows, "id long, text string")
    assert [r.t for r in df.select(extraction.opened(extraction.enveloped(F.col("text"), F.col("id") * 3)).alias("t")).collect()] == [t for _, t in rows]
    assert [r.t for r in df.select(extraction.opened(F.col("text")).alias("t")).collect()] == [t for _, t in rows]


def test_vectors_as_text(spark):
    rng = np.random.default_rng(0)
    long, short = rng.normal(size=embedding.HALF_DIMS).astype(np.float32), rng.normal(size=5).astype(np.float32)
    assert np.abs(embedding.decode_vector(embedding.encode_vector(long)) - long).max() < 0.01
    assert len(embedding.encode_vector(long)) == 4 * -(-2 * embedding.HALF_DIMS // 3)
    assert (embedding.decode_vector(embedding.encode_vector(short)) == short).all() and embedding.decode_vector(" [1, 2.5] ").tolist() == [1, 2.5]
    for bad in (np.array([np.nan]), np.full(embedding.HALF_DIMS, 1e6)):
        with pytest.raises(ValueError):
            embedding.encode_vector(bad.astype(np.float32))
    with pytest.raises(ValueError):
        embedding.decode_vector("AAAAAAA=")
    df = spark.createDataFrame([(short.tolist(),), (None,), ([],)], "v array<float>")
    back = df.select(embedding.decoded(embedding.encoded(F.col("v"))).alias("v")).collect()
    assert back[0].v == pytest.approx(short.tolist()) and back[1].v is None and back[2].v == []


def test_uuids(spark):
    names = ["a", "", "é chat 5"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", embedding.uuid5(F.col("n")).alias("u"))
    assert {r.n: r.u for r in df.collect()} == {n: str(uuid.uuid5(uuid.UUID(embedding.SESSION_NAMESPACE), n)) for n in names}
