"""Top-k, URL rules, fingerprints: small fixtures against plain versions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from hippolake.llm import fingerprints, topk, url_filters


# --- exact top-k


def plain_topk(rows, k):
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, qv in {i: min(v for j, v in whole if j == i) for i, _ in whole if i % 5 == 0}.items():
        scored = sorted(((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in whole if i != q and len(v) == len(qv)))[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)}
    return out


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 6)]) for i in range(60)]
    rows += [(100, None), (105, []), (110, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (115, [float("nan")] * 6), (120, [float("inf")] * 6), (None, [1.0] * 6), (61, rows[7][1]), (62, rows[7][1]), (63, [0.0] * 6), (65, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, asks string")
    for block in (8192, 16):
        got = {tuple(r) for r in topk.search(df, lambda c: c % 5 == 0, k=4, most_block=block, query_block=5).select("query_id", "rank", "vec_id", "score").collect()}
        assert got == plain_topk(rows, 4)
    assert topk.search(df.limit(0), lambda c: c % 5 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(few, lambda c: c == 0, k=5).collect()] == [(0, 1, 1, 131072, None)]


def test_scores_of_large_components_are_exact(spark):
    rows = [(0, [600_000.0, 1.0]), (1, [600_000.0, 0.0]), (2, [700_000.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(df, lambda c: c == 0, k=5).orderBy("rank").collect()] == [(0, 1, 2, 27525120000000000, None), (0, 2, 1, 23592960000000000, None)]
    rng = np.random.default_rng(4)
    for size in (1e3, 1e6, 1e9, 1e20, 1e200):
        rows = [(i, [float(x) for x in rng.normal(0, size, 5)]) for i in range(80)]
        rows += [(80 + i, [x + size * 1e-15 for x in rows[7 + i][1]]) for i in range(30)] + [(110, rows[3][1]), (111, [1e308] * 5)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if all(math.isfinite(256 * x) for x in v)]
        expected = set()
        for q, qv in whole:
            if q % 5 == 0:
                for rank, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in whole if i != q)[:4], 1):
                    fits = -(1 << 63) <= -s < 1 << 63
                    expected.add((q, rank, i, -s if fits else None, None if fits else str(-s)))
        for block in (32_768, 16):
            assert {tuple(r) for r in topk.search(df, lambda c: c % 5 == 0, k=4, most_block=block).collect()} == expected


def test_threshold_stops_early():
    rng = np.random.default_rng(2)
    lists = topk.SortedLists(np.arange(5000), rng.integers(-50, 50, (5000, 3)).astype(float))
    query = np.array([100.0, 1.0, 0.0])
    best = lists.top(-1, query, 3, stretch=8)
    scores = lists.vectors @ query
    order = np.lexsort((lists.ids, -scores))[:3]
    assert best == [(int(lists.ids[i]), int(scores[i])) for i in order]


# --- URL rules

URLS = [
    "http://example.com/en/1", "https://www.example.com/en/x?y", "https://a.www.example.com/en/", "http://EXAMPLE.com/fr/", "http://notexample.com/en/", "http://x.net/es/1", "http://net/fr/", "http://x.net/de/", "ftp://x.org/", None, "no scheme", "", "http://", "http://example.com", "http://com/", "http://example.com./en/", "http://a..com/z", "x://y://z.com/p", "http://é.com/en/#f", "http://example.com/en/1",
]


def plain_judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    raw, after = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    path = after[: min([after.find(c) for c in "?#" if c in after], default=len(after))]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *((max(fits)[1], max(fits)[2]) if fits else (None, "allow")))


def test_urls_match_plain_rules(spark):
    more = [*url_filters.RULES, ("example.com", "/en/1", "allow"), ("a.b", "", "block"), ("com", "/z", "block")]
    pages = spark.createDataFrame([(i, u, "h", "r", 1) for i, u in enumerate([*URLS, "http://c.a.b/q"])], "page_id long, url string, host string, rule string, depth int")
    for rules in (list(url_filters.RULES), more):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
        assert got == {i: plain_judge(u, rules) for i, u in enumerate([*URLS, "http://c.a.b/q"])}
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in url_filters.judge(pages, none).collect()} == {"allow"}
    assert url_filters.judge(pages.limit(0), url_filters.production_rules(spark)).count() == 0


# --- fingerprints

TEXTS = ["the quick brown fox jumps over the lazy dog", "The quick brown fox jumps over the lazy cat", None, "", "   ", "one", "a b " * 4000, "é😀 ü\tx\ny", "the quick brown fox jumps over the lazy dog"]


def test_edits_and_likeness(spark):
    import hashlib

    df = spark.createDataFrame([(10 * i, t, 1, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_chars int, place string")
    rows = {r.doc_id // 10: r for r in fingerprints.with_edits(df).collect()}
    assert len(rows) == len(TEXTS)
    whole = [t or "" for t in TEXTS]
    for i, text in enumerate(whole):
        after = whole[(i + 1) % len(whole)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = rows[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        other = int(r.fingerprint, 16) ^ int(rows[(i + 1) % len(whole)].fingerprint, 16)
        assert abs(r.near_next - (1 - other.bit_count() / 128)) < 1e-12
        changed = int(r.fingerprint, 16) ^ int(r.edited_fingerprint, 16)
        assert abs(r.near_edited - (1 - changed.bit_count() / 128)) < 1e-12
    assert rows[0].fingerprint == rows[8].fingerprint and rows[2].fingerprint == rows[3].fingerprint == rows[4].fingerprint == "0" * 32
    assert fingerprints.with_edits(df.limit(0)).count() == 0
    alone = fingerprints.with_edits(df.limit(1)).first()
    assert alone.near_next == 1.0
    twins = spark.createDataFrame([(None, "x y"), (None, "x y"), (1, "z"), (1, "a")], "doc_id long, text string")
    assert fingerprints.with_edits(twins).count() == 4


def test_near_pairs_are_all_found(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(1 << 63), 1 << 63, (12, 2), np.int64)
    marks = [tuple(map(int, b)) for b in base]
    for h, low in list(marks):
        for flips in (1, 3, 4, 6):
            bits = rng.choice(128, flips, replace=False)
            x = ((h & (1 << 64) - 1) << 64) | (low & (1 << 64) - 1)
            for b in bits:
                x ^= 1 << int(b)
            signed = lambda v: v - (1 << 64) if v >> 63 else v
            marks.append((signed(x >> 64), signed(x & (1 << 64) - 1)))
    df = spark.createDataFrame([*marks, marks[0], (None, 1)], "high long, low long")
    got = {((r.high, r.low), (r.other_high, r.other_low), r.distance) for r in fingerprints.near_pairs(df, 4).collect()}
    mask = (1 << 64) - 1
    distance = lambda a, b: (((a[0] ^ b[0]) & mask).bit_count() + ((a[1] ^ b[1]) & mask).bit_count())
    uniq = sorted(set(marks))
    assert got == {(a, b, distance(a, b)) for i, a in enumerate(uniq) for b in uniq[i + 1 :] if distance(a, b) <= 4}
    assert fingerprints.near_pairs(df.limit(0), 4).count() == 0
    assert fingerprints.fingerprints(spark.createDataFrame([("a b",), ("a b",), (None,)], "text string")).select(F.count("*")).first()[0] == 2
