"""Lists of words meet documents where their texts are read; a task puts out each list's first ones only."""

from __future__ import annotations

import random
import re

import __spark_entry__ as entry
from hippolake.operators import retrieval as R


def test_best_documents_are_the_plain_ones(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    texts = [(i * 3 - 200, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(500)]
    lists = {(q, part): set(rng.sample([*words, "nowhere"], rng.randint(1, 15))) for q in range(25) for part in (0, 1)}
    docs = spark.createDataFrame(texts, "id long, text string").repartition(3)
    asked = spark.createDataFrame([(q, p, w) for (q, p), ws in lists.items() for w in ws], "query_id long, part int, token string")
    wanted = set()
    for (q, p), ws in lists.items():
        hits = sorted((-len(ws & set(t.split())), i) for i, t in texts if ws & set(t.split()))
        wanted |= {(q, p, i, -n, at) for at, (n, i) in enumerate(hits[:6], 1)}
    found = lambda: {tuple(r) for r in R.best_by_shared_words(docs, asked, ["query_id", "part"], most=6).collect()}
    assert found() == wanted
    # Documents that go on in the next batch, few counters at once, several blocks of lists.
    for name, value in (("MOST_WORDS_SENT", 90), ("MOST_COUNTERS", 64)):
        monkeypatch.setattr(R, name, value)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        assert found() == wanted
    finally:
        spark.conf.set(size, before)
    nobody = R.best_by_shared_words(docs, asked.limit(0), ["query_id", "part"], most=6)
    assert nobody.columns == ["query_id", "part", "id", "n", "position"] and not nobody.collect()


def test_no_pair_of_a_list_and_a_document_is_shuffled(spark, small):
    plan = entry.queries()["H6_expansion_merge"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not re.search(r"hashpartitioning\(query_id#\w+, part#\w+, id#", plan)
