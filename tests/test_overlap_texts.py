"""Overlaps of texts against every pair counted: no posting is shuffled, and what meets under a word is never written."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pyarrow as pa

from hippolake.functions import overlaps as O
from hippolake.functions import stem as S
from hippolake.operators import retrieval as R
from hippolake.plans import retrieval as PR

WORDS = [w + end for w in ("walk", "talk", "hop", "relat", "cat", "fli", "go") for end in ("", "s", "ed", "ing", "ion", "es")] + ["as", "ies", "Über", "日本", "a1", "the", "of"]


def best_of(sets: dict[int, set], most: int = 5) -> dict:
    wanted = {}
    for new, s in sets.items():
        hits = sorted((-len(s & o) / len(o), old, len(s & o)) for old, o in sets.items() if old < new and len(s & o) / len(o) > 0.6)
        wanted |= {(new, old): (n, rank) for rank, (_, old, n) in enumerate(hits[:most], 1)}
    return wanted


def texts(rng: random.Random) -> list[tuple]:
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.choice([1, 2, 4, 9, 25])))) for i in range(0, 400, 2)]
    rows += [(i, rows[i // 4][1]) for i in range(1, 60, 2)]
    return rows + [(8, "walks of"), (8, None), (1001, None), (None, "walk"), (1003, "!"), (1005, "walk " * 40)]


def test_texts_have_the_plain_answer(spark, monkeypatch):
    plans = {}
    write = R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, label: plans.setdefault(label, []).append(df) or write(df, label))
    monkeypatch.setattr(R, "MOST_CODES", 20)
    monkeypatch.setattr(R, "MOST_POSTINGS", 700)
    docs = spark.createDataFrame(texts(random.Random(4)), "id long, text string").repartition(5)
    found = {(r.new_id, r.old_id): (r.shared, r.rank) for r in R.overlap_ratio_of_texts(docs).collect()}
    assert len(plans["carried"]) > 2 and len(plans["met"]) == 1
    sets: dict[int, set] = {}
    for r in R.blind_postings(docs.filter("id IS NOT NULL")).collect():
        sets.setdefault(r.id, set()).add(r.hash)
    assert found == best_of(sets) and len(found) > 500


def test_the_query_writes_no_row_for_a_word_that_meets(spark, monkeypatch):
    plans = {}
    write = R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, label: plans.setdefault(label, df) and write(df, label))
    talk = spark.createDataFrame([(i, 0, "the cat of the " + w) for i, w in enumerate(WORDS)], "conv_id long, turn long, text string")
    out = PR.overlap_ratio(lambda view: talk)
    assert out.count() > 0 and out.schema.simpleString() == "struct<new_id:bigint,old_id:bigint,shared:bigint,ratio:double,rank:int>"
    for label in ("sets", "met"):
        plan = plans[label]._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Generate" not in plan


def test_bounds_lose_none_of_the_best(monkeypatch):
    for name, value in (("SOME_MET", 300), ("SOME_PAIRS", 40), ("FEW_PAIRS", 10)):
        monkeypatch.setattr(O, name, value)
    rng = random.Random(5)
    codes = SimpleNamespace(value=S.codes_for(sorted({S.term_of(w.lower()) for w in WORDS})[:9], []))
    rows = {i: sorted({w.lower() for w in rng.choices(WORDS, k=rng.choice([1, 2, 3, 8, 30]))}) for i in range(300)}
    batch = pa.RecordBatch.from_pydict({"id": pa.array(list(rows), pa.int64()), "words": pa.array(list(rows.values()), pa.list_(pa.string()))})
    sets = pa.Table.from_batches(list(S.term_sets(codes)(iter([batch.slice(0, 100), batch.slice(100)]))))
    columns = O.holders(O.part_of(sets, 0.6), sets.combine_chunks().to_batches()[0], 0.6, 5)
    pairs = {(a, b): (n, size) for a, b, n, size in zip(*(c.tolist() for c in columns), strict=True)}
    plain = {i: set(words) | {t for t in map(S.term_of, words) if ":" in t} for i, words in rows.items()}
    for (new, old), (n, _) in best_of(plain).items():
        assert pairs[new, old] == (n, len(plain[old]))
    assert all(n == len(plain[a] & plain[b]) and n / size > 0.6 and b < a for (a, b), (n, size) in pairs.items())
    assert len(pairs) < sum(len(plain[a] & plain[b]) / len(plain[b]) > 0.6 for a in plain for b in plain if b < a)


def test_terms_of_one_digest_have_codes_of_their_own(monkeypatch):
    monkeypatch.setattr(S, "DIGESTS", 7)
    terms = sorted({S.term_of(w) for w in WORDS} | set(WORDS))
    digests = S.digests_of(terms).tolist()
    alike = [t for t, d in zip(terms, digests, strict=True) if digests.count(d) > 1]
    codes = S.codes_for(terms[5:9], alike).of(terms)
    assert len(set(codes.tolist())) == len(terms) > 7 and sorted(codes[5:9].tolist(), reverse=True) == codes[5:9].tolist() == [3, 2, 1, 0]
