"""Texts and tables that once stopped a job or bent a result: long runs, ids repeated very often, crowded regions, columns without order."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hippolake.llm import fingerprints, mixing, near_dups, packing, quality, secrets

#: What each rule's matches begin with, or nearly.
PREFIXES = {
    "assign": ["token", "token ", "token=", "password:", "secret = \"", "api_key"], "access": ["AKIA", "AKIA-"], "hex": ["0123456789abcdef", "abcg"], "private_key": ["-----BEGIN ", "-----BEGIN A", "PRIVATE KEY", "-----BEGIN PRIVATE KEY----"],
    "github": ["ghp_", "ghp_a"], "slack": ["xoxb-", "xoxb"], "google": ["AIza", "AIza_"], "stripe": ["sk_live_", "rk_live_a"], "web_token": ["eyJ", ".eyJ", "eyJaaaaaaaa."],
}


def test_every_rules_prefix_repeated(spark):
    texts = [lead + prefix * 100_000 for prefixes in PREFIXES.values() for prefix in prefixes for lead in ("", ".eyJ ", "-----BEGIN ")]
    assert set(PREFIXES) == {r.kind for r in secrets.RULES}
    began = time.perf_counter()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    assert secrets.digest(secrets.scan(docs)).count() == len(texts)
    assert time.perf_counter() - began < 120


def test_a_web_token_is_found_where_it_stands(spark):
    token = "eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0"
    texts = [f"x {token} y", f"a.{token}", f"x{token}", "eyJshort." + token]
    rows = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "web_token"] for r in rows}
    assert found == {0: [(2, 2 + len(token))], 1: [(2, 2 + len(token))], 2: [], 3: [(9, 9 + len(token))]}


@pytest.mark.parametrize("blank", [" ", "\t", "\n", "\x0b", "\x0c", "\r", " \n"])
def test_runs_of_blanks(spark, blank):
    began = time.perf_counter()
    texts = [f"x{blank * 1_000_000}y", f"{blank * 1_000_000}x{blank}y{blank * 1_000_000}", "x y", "x\x1cy"]
    rows = fingerprints.with_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r.doc_id: r.fingerprint for r in rows}
    assert found[0] == found[1] == found[2] != found[3]
    assert time.perf_counter() - began < 60


def test_full_pieces_have_sequences_of_their_own(spark):
    docs = spark.createDataFrame([(i, "word " * n) for i, n in enumerate([5000, 3000, 10, 0, 700, 1, 2048, 8000])] + [(9, None)] + [(10, "a b c")] * 50, "doc_id long, text string")
    rows = packing.pack(docs, capacity=256).collect()
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.padded_to))
    for pieces in sequences.values():
        at = 0
        for offset, length, padded in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256 and padded == (at if at & (at - 1) == 0 else 256)
    assert any(r.length == 256 for r in rows) and sum(r.length for r in rows if r.start == 0 and r.doc_id == 9) == 1


def test_what_is_remembered_of_segments_is_bounded_by_bytes():
    memo = packing._Memo(lambda s: s.encode() * 3, 10_000)
    for i in range(5000):
        assert memo[f"segment {i}"] == f"segment {i}".encode() * 3
    assert len(memo) + len(memo.old) < 2 * 10_000 / packing.ENTRY_BYTES + 2


def test_one_labelled_id_in_very_many_rows(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(quality, "fit", lambda p, u, *a, **k: (_ for _ in ()).throw(StopIteration) if fitted.append((len(p), len(u))) else None)
    good = next(i for i in range(100) if spark.range(1).select(quality.remainder(F.lit(i))).first()[0] != 0)
    docs = spark.range(20_000).selectExpr(f"{good}L AS doc_id", "concat('text ', id) AS text").unionAll(spark.range(20_000).selectExpr(f"{good}L AS doc_id", "'the same' AS text"))
    labels = spark.createDataFrame([(good, 1)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "estimated_prior", lambda p, u: 0.5)
    quality.train(docs, labels, fit_positives=100, fit_unlabelled=200)
    positives, unlabelled = fitted[-1]
    assert positives <= 130 and unlabelled <= 250


def _entries(keys, sketches, sizes):
    n = len(keys)
    return pa.RecordBatch.from_arrays(
        [pa.array([0] * n, pa.int32()), pa.array(keys, pa.binary()), pa.array(range(n), pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array([False] * n), pa.array([0] * n, pa.int32())],
        ["tree", "key", "node", "n_shingles", "sketch", "wide", "deal"],
    )


@pytest.mark.parametrize("rows", [5_000, 20_100, 40_200])
def test_the_rest_of_a_region_that_is_cut_is_crowded_too(rows):
    rng = np.random.default_rng(1)
    start = b"\x00\x01" * near_dups.START
    keys = sorted(start + rng.bytes(2 * (near_dups.UNITS - near_dups.START)) for _ in range(rows))
    sketches = [rng.bytes(32) for _ in range(rows)]
    sketches[-1] = sketches[10]
    batch = _entries(keys, sketches, [100 + i for i in range(rows)])
    touched = set()
    for out in near_dups._regions(80, "first")(iter([batch.slice(i, 1000) for i in range(0, rows, 1000)])):
        touched |= set(out.column("a").to_pylist()) | set(out.column("b").to_pylist())
    assert len(touched) == rows


def test_columns_that_have_no_order(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text, {"a": 1}, ({"b": 2},), 3), (1, text, {"a": 0}, ({"b": 2},), 3), (2, text, None, None, None), (3, "", {"a": 1}, None, 1)], "doc_id long, text string, m map<string,int>, s struct<n:map<string,int>>, o int")
    out = near_dups.deduplicate(docs)
    rows = out.collect()
    assert out.dtypes == docs.dtypes and sorted(r.doc_id for r in rows) == [1, 3] and [r.m for r in rows if r.doc_id == 1] == [{"a": 0}]


def test_the_mix_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(1, f"word{i} and more", "s" if i % 3 else "t", i % 5) for i in range(2000)] + [(2, "same text here", "s", i) for i in range(500)], "doc_id long, text string, source string, extra int")
    seen = []
    for parts in (3, 7):
        plan = mixing.plan(docs.repartition(parts), payload=docs.columns, block_words=600, shards=20)
        seen.append(sorted((r.payload.doc_id, r.payload.text, r.payload.source, r.payload.extra, r.copies, tuple(r.shards)) for r in plan.collect()))
    assert seen[0] == seen[1]


def test_many_shards_cost_little(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('w', id, ' x') AS text", "'s' AS source")
    took = []
    for shards in (1000, 16_000):
        began = time.perf_counter()
        plan = mixing.plan(docs, block_words=2, shards=shards)
        assert plan.agg(F.sum(F.size("shards"))).first()[0] == 4000
        took.append(time.perf_counter() - began)
    assert took[1] < 2 * took[0] + 5
