"""What a query is about, word for word as the SQL's expressions see it."""

from __future__ import annotations

import duckdb

from hippolake.plans.retrieval import FACTUAL, TEMPORAL, intent

ODD = [
    "Do \u00f1do que se.", "Do ndo", "what\u00e9 is", "\u00e9when", "when\u0301", "is  \x0bx", "is \u00e9", "WHEN?", "last\x0bweek", "last\n week", "do _x", "wa\u017f x", "\u017fince",
    "a\u017fter all, today", "this wee\u212a", "whe\u0131n", "how\u00a0many x", "d\u0130d x", "\u0130s x", "recently", "it is", "did " + "x" * 76, "did " + "x" * 75, "", None, "thi\u017f week", "this\x0cmonth",
]


def test_intents_of_odd_texts_are_those_of_the_sql(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "id int, text string")
    ours = {r.id: r.intent for r in rows.select("id", intent(F.col("text")).alias("intent")).collect()}
    sql = f"SELECT CASE WHEN regexp_matches(t, '{TEMPORAL}') THEN 'temporal' WHEN regexp_matches(t, '{FACTUAL}') AND length(t) < 80 THEN 'factual' ELSE 'semantic' END FROM (SELECT $1::VARCHAR AS t)"
    theirs = {i: duckdb.execute(sql, [t]).fetchall()[0][0] for i, t in enumerate(ODD)}
    assert ours == theirs


def test_a_page_without_id_asks_nothing(spark):
    from hippolake.plans import retrieval

    pages = spark.createDataFrame([(None,), (5,)], "page_id long")
    tables = {"pages": pages, "benchmark": spark.createDataFrame([], "item_id long, text string"), "conversations": spark.createDataFrame([], "conv_id long, turn int, text string")}
    found = sorted((r.id is None, r.intent) for r in retrieval.query_intent(tables.get).collect())
    assert found == [(False, "factual"), (False, "temporal"), (True, "semantic"), (True, "semantic")]
