"""Stems: the published examples and golden values, in Spark and in the comparison engine."""

from __future__ import annotations

import hashlib

import duckdb

from hippolake.functions import stem
from hippolake.operators import retrieval

# Pairs that the published algorithm must give.
EXPECTED = dict(
    x.split(":")
    for x in (
        "applications:applic prefers:prefer running:run community:commun communities:commun argued:argu argues:argu arguing:argu deadline:deadlin project:project expertise:expertis chosen:chosen "
        "because:becaus python:python user:user dark:dark mode:mode march:march over:over team:team "
        "caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop "
        "tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc hesitanci:hesit digitizer:digit "
        "conformabli:conform radicalli:radic differentli:differ vileli:vile analogousli:analog vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis hopefulness:hope "
        "callousness:callous formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic formative:form formalize:formal electriciti:electr electrical:electr hopeful:hope goodness:good "
        "revival:reviv allowance:allow inference:infer airliner:airlin gyroscopic:gyroscop adjustable:adjust defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt "
        "homologou:homolog communism:commun activate:activ angulariti:angular homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll "
        "enjoy:enjoi syzygy:syzygi toy:toi by:by yes:ye youyou:youyou 15th:15th müller:müller"
    ).split()
)


def test_published_examples(spark):
    words = spark.createDataFrame([(w,) for w in EXPECTED], "token string")
    assert {r.token: r.stem for r in stem.with_stems(words).collect()} == EXPECTED


def test_both_engines_agree(spark, small):
    found = spark.read.parquet(f"{small}/documents.parquet").selectExpr("explode(split(lower(text), '[^a-z]+')) AS token").distinct()
    ours = {r.token: r.stem for r in stem.with_stems(found).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE words (token VARCHAR)")
    con.executemany("INSERT INTO words VALUES (?)", [[w] for w in [*ours, *EXPECTED]])
    theirs = dict(con.execute(stem.stems_sql("words")).fetchall())
    assert all(theirs[w] == s for w, s in {**ours, **EXPECTED}.items()) and len(ours) > 100


def test_indices_are_words_and_stems_in_order(spark):
    df = spark.createDataFrame([(1, "Prefers dark, prefer DARK x"), (2, ""), (3, None)], "id long, text string")
    got = {r.id: r.hashes for r in retrieval.blind_indices(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {1: [sha("prefers"), sha("stem:prefer"), sha("dark"), sha("stem:dark"), sha("prefer")], 2: [], 3: []}
    # Golden value of a stem's digest.
    assert got[1][1] == "4797c7aef1457415713009084e978703f4d47152adf2a4c9dbf261d3fb8fa72e"
