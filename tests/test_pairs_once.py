"""Pairs of several blocks come once and aren't moved afterwards; they leave a task tile by tile."""

from __future__ import annotations

import numpy as np

from hippolake.functions import vectors as V
from hippolake.functions.text import entity_id
from hippolake.operators import knowledge as K


def test_pairs_of_several_entities(spark, monkeypatch):
    rng = np.random.default_rng(9)
    names = ["Ann", "ann ", "Bo", "Cy", "Dee"]
    rows = [(i, [names[k] for k in rng.permutation(5)[: i % 5]], rng.normal(size=4).tolist()) for i in range(160)]
    rows += [(500, None, [1.0, 0.0, 0.0, 0.0]), (501, ["Ann", None], None), (502, [None, "Bo"], [0.0, 1.0, 0.5, 0.0])]
    df = spark.createDataFrame(rows, "id long, entities array<string>, embedding array<double>")
    ids = {r.n: r.e for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", entity_id("n").alias("e")).collect()}
    has = [(i, list(dict.fromkeys(ids[n] for n in e if n is not None)), np.array(v) / np.linalg.norm(v)) for i, e, v in rows if e and v]
    wanted = {}
    for a in has:
        for b in has:
            shared = [e for e in b[1] if e in a[1]]
            if a[0] < b[0] and shared and 0.3 <= a[2] @ b[2] < 0.85:
                wanted[a[0], b[0]] = (shared[0], len(shared))
    for size, some in ((1024, 1 << 16), (16, 5)):
        monkeypatch.setattr(V, "BLOCK_ROWS", size)
        monkeypatch.setattr(V, "SOME_PAIRS", some)
        out = K.shared_entities(df, 0.3, 0.85)
        found = [(r.a, r.b, r.entity_id, r.n_shared) for r in out.collect()]
        assert len(found) == len(wanted) and {(a, b): (e, n) for a, b, e, n in found} == wanted
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(a" not in plan and "hashpartitioning(b#" not in plan


def test_rows_are_dealt_to_few_large_parts(spark):
    """20,000 rows meet as 13 parts at most, where parts of 1,024 rows would be 20."""
    df = spark.range(20_000).selectExpr("id", "array(cast(id % 101 - 50 as double), cast(id % 7 as double)) AS v")
    pairs = V.cosine_pairs(df, 1.1, id_col="id", vector_col="v")
    plan = pairs._jdf.queryExecution()
    assert pairs.count() == 0 and "repartition" in plan.logical().toString().lower()
    sent = [n for n in str(plan.executedPlan().toString()).splitlines() if "REPARTITION_BY_NUM" in n]
    assert sent
