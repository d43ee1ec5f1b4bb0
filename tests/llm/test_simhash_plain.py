"""SimHash fingerprints and near counts against a plain version."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from hippolake.llm import fingerprints

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def chained(*parts: bytes) -> int:
    seed = 42
    for part in parts:
        seed = xxhash.xxh64(part, seed=seed).intdigest()
    return seed


def plain_fingerprint(text: str | None) -> str:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    pairs = list(zip(words, words[1:], strict=False)) or [(w, None) for w in words[:1]]
    first = [chained(*(w.encode() for w in pair if w is not None)) for pair in pairs]
    second = [chained(h.to_bytes(8, "little"), (1).to_bytes(4, "little")) for h in first]
    out = 0
    for hashes in (first, second):
        bits = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
        out = out << 64 | bits
    return f"{out:032x}"


def made_texts() -> list[str | None]:
    rng = np.random.default_rng(11)
    base = " ".join(f"W{x}" for x in rng.integers(0, 900, 3000))
    texts = [base, base + " more", "start " + base, base.replace("W1 ", "V1 "), None, "", "one", "One", "two words", "é 日本 \t x\x0by", base]
    return texts + [" ".join(f"w{x}" for x in rng.integers(0, 50, n)) for n in (1, 2, 3, 40, 700)]


def test_fingerprints_are_plain_simhash(spark):
    texts = made_texts()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, high int")
    rows = {r.doc_id: r for r in fingerprints.with_edits(df).collect()}
    plain = [plain_fingerprint(t) for t in texts]
    for i, text in enumerate(texts):
        assert rows[i].fingerprint == plain[i]
        cut, after = len(text or "") // 4, texts[(i + 1) % len(texts)] or ""
        assert rows[i].edited_fingerprint == plain_fingerprint((text or "")[: len(text or "") - cut] + after[:cut])
        others = {p for p in plain if p != plain[i] and (int(p, 16) ^ int(plain[i], 16)).bit_count() <= fingerprints.NEAR_BITS}
        assert rows[i].n_near == len(others)
    assert any(r.n_near for r in rows.values())


def test_many_stretches_give_the_same(spark, monkeypatch):
    texts = made_texts() * 3
    ids = [None if i % 11 == 0 else 7 if i % 7 == 0 else i * 3 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    key = lambda df: sorted(map(repr, df.collect()))
    whole = key(fingerprints.with_edits(df))
    monkeypatch.setattr(fingerprints, "STRETCH_ROWS", 3)
    assert key(fingerprints.with_edits(df)) == whole


def test_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "ab cd " * 500_000), (2, "x" * 3_000_000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in fingerprints.with_edits(df).collect()}
    assert rows[1].n_chars == 3_000_000 and rows[2].fingerprint == plain_fingerprint("x" * 3_000_000)
