"""Near-duplicates, components, mixing, quality: small fixtures against plain versions."""

from __future__ import annotations

import re

import numpy as np
import pytest

from hippolake.llm import components, mixing, near_dups, quality
from hippolake.storage import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, width):
    words = WORD.findall((text or "").translate(UPPER))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_groups(docs, width, percent):
    sets = [plain_set(t, width) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    named: dict = {}
    for i, (doc_id, _) in enumerate(docs):
        named.setdefault(root(i), []).append(doc_id)
    smallest = {r: min((x for x in ids if x is not None), default=None) for r, ids in named.items()}
    return sorted(((d, len(sets[i]), smallest[root(i)]) for i, (d, _) in enumerate(docs)), key=repr)


def made_docs():
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 400, 60)) for _ in range(8)]
    docs = []
    for text in base:
        for _ in range(9):
            words = text.split()
            for _ in range(rng.integers(0, 7)):
                words[rng.integers(0, len(words))] = f"v{rng.integers(0, 50)}"
            docs.append(" ".join(words))
    docs += [base[0], base[0].upper(), "one", "One", "two words", "", None, " \t ", "É x", "é x", "a　b c", "x " * 30_000]
    return [(i * 3, t) for i, t in enumerate(docs)] + [(None, base[1]), (None, "alone here now"), (6, docs[2])]


@pytest.mark.parametrize("width", [2, 5])
def test_groups_match_brute_force(spark, width):
    docs = made_docs()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, label int, node string")
    rows = near_dups.group(df, width=width, percent=80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr) == plain_groups(docs, width, 80)
    for r in rows:
        assert r.kept == (r.component_id is None or r.doc_id == r.component_id)


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dups.group(df).count() == 0


@pytest.mark.parametrize("sizes", [{"REGION_ROWS": 4}, {"REGION_ROWS": 4, "PART_ROWS": 5}, {"REGION_ROWS": 4, "HELD_ROWS": 20, "PART_ROWS": 7}, {"REGION_ROWS": 4, "WIDE_ROWS": 10, "SAMPLE": 1}])
def test_crowded_regions_lose_nothing(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(near_dups, name, value)
    docs = made_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = near_dups.group(df, width=2, percent=80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr) == plain_groups(docs, 2, 80)


@pytest.mark.parametrize("width", [2, 5])
def test_one_row_of_each_group_stays(spark, width):
    docs = made_docs()
    docs += [(6, "quite another text with the id of the third one"), (None, "alone here now"), (None, ""), docs[0], (0, None)]
    df = spark.createDataFrame([(i, t, n % 2, "x") for n, (i, t) in enumerate(docs)], "doc_id long, text string, row int, key string")
    kept = near_dups.deduplicate(df, width=width, percent=80)
    assert kept.columns == df.columns
    rows = kept.collect()
    texts = [(n, t) for n, (_, t) in enumerate(docs)]  # groups of rows, whatever their ids
    groups: dict = {}
    for n, _, root in plain_groups(texts, width, 80):
        groups.setdefault(root, []).append(n)
    expected = []
    for members in groups.values():
        worded = plain_set(docs[members[0]][1], width)
        stays = min(((docs[n][0] is None, docs[n][0] or 0) for n in members)) if worded else None
        expected.append(repr((None if stays[0] else stays[1]) if worded else docs[members[0]][0]))
    assert sorted(repr(r.doc_id) for r in rows) == sorted(expected)
    assert all((r.doc_id, r.text) in docs for r in rows)
    assert near_dups.deduplicate(df.limit(0)).count() == 0


def test_recall_of_borderline_pairs_in_a_crowded_region(spark):
    """600 pairs at 0.80 to 0.82, all sharing enough with each other to crowd the regions: each pair is found, at the real sizes."""
    rng = np.random.default_rng(12)
    shared = [f"s{i}" for i in range(240)]
    docs = []
    for k in range(600):
        own = [f"o{k}x{i}" for i in range(160)]
        left = shared + own
        right = shared + own[:116] + [f"r{k}x{i}" for i in range(44)]
        docs += [" ".join(left), " ".join(right)]
    order = rng.permutation(len(docs))
    sets = [set(near_dups.shingles(t, 2).tolist()) for t in docs]
    assert all(100 * len(sets[i] & sets[i + 1]) >= 80 * len(sets[i] | sets[i + 1]) for i in range(0, len(docs), 2))
    rows = near_dups.group(spark.createDataFrame([(int(i), docs[i]) for i in order], "doc_id long, text string"), width=2).collect()
    together = {r.doc_id: r.component_id for r in rows}
    found = sum(together[i] == together[i + 1] for i in range(0, len(docs), 2))
    assert found >= 0.99 * 600
    assert len({r.component_id for r in rows}) >= 590  # and strangers stay apart


def test_profiles_bound_what_sets_share():
    rng = np.random.default_rng(6)
    for n in (3, 200, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n).astype(np.uint64)]))
        rows = [np.frombuffer(near_dups.profile(x), np.uint8)[None, :] for x in (a, b)]
        assert near_dups.most_shared(*rows)[0] >= len(np.intersect1d(a, b))
    full = np.full((1, near_dups.PROFILE), 255, np.uint8)
    assert near_dups.most_shared(full, full)[0] >= 1 << 40


@pytest.mark.parametrize("task_links", [1_000_000, 20])
def test_components_in_one_part_and_in_rounds(spark, task_links):
    rng = np.random.default_rng(7)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 200, (90, 2))] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5), (1, 2), (2, 1)]
    df = spark.createDataFrame(links + [(None, 3)], "a long, b long")
    parent = {x: x for pair in links for x in pair}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.label for r in components.components(df, task_links=task_links).collect()}
    assert got == {x: root(x) for x in linked}


# --- mixing


def test_targets_stop_at_three_times():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 300) == [187.5, 75.0, 37.5]
    assert mixing.targets([10, 1000, 0], [5, 2, 1], 1010) == [30.0, 980.0, 0.0]
    assert mixing.targets([], [], 0) == []


def test_split_is_exact():
    counts = np.array([7, 0, 100, 1])
    out = mixing.split(counts, 6, 1)
    assert out.shape == (6, 4) and (out.sum(0) == counts).all() and (out >= 0).all()
    sizes = out.sum(1)
    assert sizes.max() - sizes.min() <= 2 and (mixing.split(counts, 6, 1) == out).all()


def test_mix_meets_targets_and_repeats_itself(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), ["b", "a", None, "é", "Z"][i % 5] if i % 3 else "b", 9, 1, "x") for i in range(400)]
    rows += [(None, "a b c", "b", 9, 1, "x"), (5, None, "a", 9, 1, "x"), (5, None, "a", 9, 1, "x"), (7, "q r", "empty", 9, 1, "x"), (8, "", "void", 9, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, block int, shards string")
    for words in (300, 100_000):
        plan = mixing.plan(df, block_words=words, shards=8)
        got = plan.collect()
        assert len(got) == len(rows)
        by: dict = {}
        for r in got:
            by.setdefault(r.source, []).append(r)
            assert 0 <= r.copies <= 3 and len(r.shards) == r.copies and all(0 <= s < 8 for s in r.shards)
        for source, mine in by.items():
            taken = sum(r.size * r.copies for r in mine)
            assert mine[0].source_size == sum(r.size for r in mine)
            assert abs(taken - mine[0].target) <= max(1, 0.02 * mine[0].target), source
        assert by["void"][0].target == 0 and sum(m[0].target for m in by.values()) == pytest.approx(sum(r.size for r in got))
        again = mixing.plan(df.repartition(7), block_words=words, shards=8).collect()
        key = lambda r: (repr(r.doc_id), repr(r.source), r.size, r.copies)
        assert sorted(map(key, got)) == sorted(map(key, again))
    out = mixing.emit(mixing.plan(df, payload=df.columns, shards=8))
    assert out.count() == sum(r.copies for r in got)
    assert mixing.plan(df.limit(0)).count() == 0


def test_what_is_taken_is_what_shards_draw(spark, monkeypatch):
    rows = [(i, "w " * 50, "ab"[i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    whole = mixing.plan(df, block_words=200, shards=4).collect()
    assert {s for r in whole for s in r.shards} == set(range(4))
    dealt = mixing.split
    monkeypatch.setattr(mixing, "split", lambda counts, shards, seed: np.concatenate([dealt(counts, shards, seed)[:-1], np.zeros((1, len(counts)), np.int64)]))
    less = mixing.plan(df, block_words=200, shards=4).collect()
    assert {s for r in less for s in r.shards} == set(range(3))
    assert sum(r.copies for r in less) == sum(s < 3 for r in whole for s in r.shards)


def test_many_sources_are_refused_and_long_texts_emitted(spark, monkeypatch):
    rows = [(1, "w " * 400_000, "a"), (2, None, "a"), (3, "", None), (3, "", None), (4, "x y", "b")]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, source string, shard int, copy int")
    planned = mixing.plan(df, payload=df.columns, shards=3)
    out = mixing.emit(planned).collect()
    assert len(out) == sum(r.copies for r in planned.collect()) and {len(r.payload.text or "") for r in out} <= {0, 3, 800_000}
    assert mixing.emit(mixing.plan(df.limit(0))).count() == 0
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    with pytest.raises(ValueError):
        mixing.plan(df)


# --- quality


def test_features_do_not_depend_on_stretches(monkeypatch):
    text = "Word " * 300 + "\n| a | b | ### é " * 50 + "LOUD!! " * 40
    whole = quality.features(text)
    assert (quality.features(None) == 0).all() and (quality.features(" \n") == 0).all()
    monkeypatch.setattr(quality, "STRETCH", 700)
    assert np.abs(quality.features(text) - whole).max() < 0.15  # windows fall elsewhere, sums don't


def test_pu_learning_finds_the_negatives():
    rng = np.random.default_rng(9)
    good, bad = rng.normal(1, 1, (400, 4)), rng.normal(-2, 1, (150, 4))
    model = quality.fit(good[:200], np.concatenate([good[200:], bad]), 200 / 350)
    scores, labels = model.score(np.concatenate([good, bad])), np.array([1] * 400 + [0] * 150)
    assert ((scores >= 0.5) == labels).mean() > 0.95


def test_held_out_accuracy(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    scored = quality.score(docs, quality.train(docs, labels))
    held = scored.join(labels, "doc_id").filter(quality.remainder(scored["doc_id"]) == 0).collect()
    assert len(held) > 5 and sum((r.score >= 0.3) == (r.quality == 1) for r in held) / len(held) > 0.9


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 2.0), (2, "", 2.0), (None, "a b", 2.0), (3, "x" * 100_000, 2.0), (3, "x" * 100_000, 2.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.train(docs.limit(0), labels.limit(0)).prior == quality.DEFAULT_PRIOR
