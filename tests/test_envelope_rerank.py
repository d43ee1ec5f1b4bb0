"""The ranking of facts in envelopes reads the opened texts, and gives what the plain texts give."""

from __future__ import annotations

from hippolake.operators import retrieval as R
from hippolake.plans import extraction
from hippolake.plans import retrieval as PR

TEXTS = {
    3: 'dark "mode"\nin the agent\\editor \u0001 {x}', 4: '{"t": "dark", "a": "agent"}', 5: '  {"t": 5} mode', 6: None, 7: None, 8: "", 9: "", 10: '{"mode": 1}', 11: "{dark",
    12: "Dark modes", 13: "dark mode", 14: "\n{\"t\": \"x\"} mode", 15: '{"t": "inner dark"}', 16: '{"t": null, "dark": 1}', 17: "\U0001f319 dark mode", 18: "\U0001f319 dark mode",
}


def role_of(spark):
    facts = spark.createDataFrame([(i, t, "user", 0.5, 0.1, i) for i, t in TEXTS.items()], "id long, text string, source string, decay_score double, importance double, created_at long")
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in TEXTS if i % 4], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, "dark mode", [1.0, 0.5]), (2, "agent", None), (3, "inner editor", [0.0, 1.0])], "query_id long, text string, embedding array<double>")
    views = {"fact_rows": facts, "facts": facts, "embeddings": vectors, "asked": asked}
    return views.__getitem__


def test_opened_texts_rank_as_the_plain_ones(spark):
    role = role_of(spark)
    plain = PR._shown(R.top_k(R.fuse(PR.scored(role)), PR.KEEP))
    found = extraction.envelope_rerank(role)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    # The envelope's own "agent" is no word of a text without it.
    assert {r.id for r in found.filter("query_id = 2").collect()} == {3, 4}


def test_what_opening_gives_is_what_is_searched(spark, monkeypatch):
    monkeypatch.setattr(extraction, "opened", lambda blob: blob)
    closed = extraction.envelope_rerank(role_of(spark))
    assert {r.id for r in closed.filter("query_id = 2").collect()} > {12, 18}
