"""The pipeline's stages on the smallest tables, each against a plain version of its step on its own input."""

from __future__ import annotations

import corpus_pipeline as pipeline
import numpy as np
import zlib

from hippolake.llm import packing, quality, secrets
from hippolake.storage import materialize, table
from tests.llm.test_models_and_groups import plain_groups


def test_each_stage(spark, small):
    names = [name for name, _ in pipeline.STAGES]
    assert names == ["quality", "near_dups", "secrets", "mixing", "packing"]
    docs = table(spark, small, "documents")
    columns, steps = docs.columns, [docs]
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, small), f"test-{name}")
        steps.append(docs)
    assert all(s.columns == columns for s in steps[:-1])
    rows = [s.collect() for s in steps]

    # Quality: exactly what the model scores at the threshold or above, unchanged.
    model = quality.train(steps[0], table(spark, small, "labels"))
    good = {r.doc_id for r in rows[0] if model.score(quality.features(r.text)[None, :])[0] >= pipeline.QUALITY_LEAST}
    assert {tuple(r) for r in rows[1]} == {tuple(r) for r in rows[0] if r.doc_id in good} and 0 < len(rows[1]) < len(rows[0])

    # Near-duplicates: the smallest id of each brute-force group.
    groups = plain_groups([(r.doc_id, r.text) for r in rows[1]], 5, 80)
    assert sorted(r.doc_id for r in rows[2]) == sorted({i if n == 0 else c for i, n, c in groups})

    # Secrets: all documents stay; texts change where there are spans, and there only.
    spans = {r.doc_id: r.spans for r in secrets.scan(steps[2]).collect()}
    before, after = {r.doc_id: r for r in rows[2]}, {r.doc_id: r for r in rows[3]}
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert (r.text == before[i].text) == (not spans[i]) and r.n_chars == len(r.text)
        assert all(before[i].text[s.start : s.end] not in r.text for s in spans[i])

    # Mix: only documents that came in, none more than three times.
    copies: dict = {}
    for r in rows[4]:
        assert tuple(r) == tuple(after[r.doc_id])
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 3

    # Packing: each copy's ids, whole and in order.
    encode = packing.SegmentIds(packing.default_tokenizer())
    pieces: dict = {}
    for r in rows[5]:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    end = np.array([0], "<u4").tobytes()
    for i, n in copies.items():
        ids = encode(after[i].text) + end
        expected = [(at // 4096 * 1024, len(ids[at : at + 4096]) // 4, zlib.crc32(ids[at : at + 4096])) for at in range(0, len(ids), 4096)]
        assert sorted(pieces[i]) == sorted(expected * n)
    assert pieces.keys() == copies.keys()


def test_no_documents(spark, small):
    docs = table(spark, small, "documents").limit(0)
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, small), f"none-{name}")
        assert docs.count() == 0
