"""Tasks of the retrieval quality follow from the rows, not from the session."""

from __future__ import annotations

from hippolake.plans import analytics
from hippolake.plans.catalog import QUERIES


def test_rows_are_dealt_to_as_many_tasks_as_they_need(spark, small, monkeypatch):
    whole = {tuple(r) for r in QUERIES["A16_retrieval_quality"](spark, small).collect()}
    monkeypatch.setattr(analytics, "TASK_ITEMS", 300)
    df = QUERIES["A16_retrieval_quality"](spark, small)
    tasks = -(-spark.read.parquet(f"{small}/lineitem.parquet").count() // 300)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert tasks > 4 and plan.count(f", {tasks}), REPARTITION_BY_NUM") >= 4
    assert {tuple(r) for r in df.collect()} == whole
