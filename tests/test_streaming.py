"""Streams over the small tables, run to their end with availableNow."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from hippolake.storage import table
from hippolake.streaming import pipelines as P


@pytest.fixture(scope="module")
def log(spark, small, tmp_path_factory):
    """The events in four files."""
    path = str(tmp_path_factory.mktemp("log") / "events")
    rows = table(spark, small, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "user_id", "event_type", "value", "props")
    rows.repartitionByRange(4, "event_id").write.parquet(path)
    return path


def ended(stream, tmp_path, name: str, mode: str = "append"):
    run = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    run.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_state_replay(spark, log, tmp_path):
    stream = P.pull(spark, log, files=1).select(F.col("user_id").alias("fact_id"), F.col("event_id").alias("seq"), (F.pmod(F.floor("value"), F.lit(100)) / 100).alias("decay_score"))
    P.write_changes(P.latest_state(stream), str(tmp_path / "c"), str(tmp_path / "t"), batches=2).trigger(availableNow=True).start().awaitTermination(120)
    state = P.current(spark, str(tmp_path / "t"))
    events = spark.read.parquet(log)
    expected = {(r.user_id, r.last, r.n) for r in events.groupBy("user_id").agg(F.max("event_id").alias("last"), F.count("*").alias("n")).collect()}
    assert {(r.fact_id, r.seq, r.writes) for r in state.collect()} == expected


def test_rate_limit_and_trigger(spark, log, tmp_path):
    hits = P.pull(spark, log).select("user_id", "event_id", F.unix_timestamp("ts").alias("at"))
    got = {r.event_id: r.allowed for r in ended(P.rate_limited(hits, 3, 36_000), tmp_path, "limited").collect()}
    expected, recent = {}, {}
    for r in sorted(spark.read.parquet(log).select("user_id", "event_id", F.unix_timestamp("ts").alias("at")).collect(), key=lambda r: (r.at, r.event_id)):
        held = [t for t in recent.get(r.user_id, []) if t > r.at - 36_000]
        expected[r.event_id] = len(held) < 3
        recent[r.user_id] = held + [r.at] * expected[r.event_id]
    assert got == expected
    fired = ended(P.turn_trigger(P.pull(spark, log), 3, key="user_id"), tmp_path, "fired").groupBy("user_id").count().collect()
    counts = {r.user_id: r["count"] for r in spark.read.parquet(log).groupBy("user_id").count().collect()}
    assert {r.user_id: r["count"] for r in fired} == {u: n // 3 for u, n in counts.items() if n >= 3}


def test_sessions_and_samples(spark, log, tmp_path):
    samples = ended(P.rolling_samples(P.pull(spark, log), 100), tmp_path, "samples")
    held: dict = {}
    for r in spark.read.parquet(log).orderBy("event_id").collect():
        held.setdefault(r.user_id, []).append(r.value)
    expected = {u: sorted(v[-100:]) for u, v in held.items()}
    got = {r.user_id: r for r in samples.collect()}
    assert samples.count() == len(got) and got.keys() == expected.keys()
    for user, values in expected.items():
        assert got[user].samples == len(values) and got[user].mean == pytest.approx(sum(values) / len(values))
        assert got[user].p95 == values[min(int(len(values) * 0.95), len(values) - 1)]
    sessions = ended(P.gap_sessions(P.pull(spark, log), "12 hours"), tmp_path, "sessions")
    assert 0 < sessions.count() <= 1000 and sessions.filter("ended < began").count() == 0


def test_idle_conversations_are_swept_once(spark, log, tmp_path):
    stream = P.idle_sweep(P.pull(spark, log).select("user_id"), 500, key="user_id")
    run = stream.writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "idle")).trigger(processingTime="500 milliseconds").start()
    expected = {r.user_id: r["count"] for r in spark.read.parquet(log).groupBy("user_id").count().collect()}
    try:
        for _ in range(120):
            got: dict = {}
            for r in spark.table("idle").collect():
                got[r.user_id] = got.get(r.user_id, 0) + r.turns
            if got == expected:
                break
            run.awaitTermination(1)
    finally:
        run.stop()
    assert got == expected


def test_jsonl_tail(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    lines = [{"id": "1", "ts": "2024-01-01T00:00:00Z", "type": "prompt.submitted", "data": {"prompt": "hi"}}, {"id": "2", "ts": "2024-01-01T00:00:01Z", "type": "model.completed", "data": {"assistantTexts": ["a", "b"]}}, {"type": "other"}]
    (folder / "a.jsonl").write_text("\n".join(map(json.dumps, [*lines, lines[0]])) + "\nnot json\n")
    rows = ended(P.deduplicated(P.tail_jsonl(spark, str(folder)), "id"), tmp_path, "tail").collect()
    assert sorted((r.role, r.text) for r in rows) == [("assistant", "a\nb"), ("user", "hi")]


def test_drain_and_resume(spark):
    pending = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, owner string")
    assert [r.id for r in P.drain(pending, spark.createDataFrame([(1,)], "id long"), "a").collect()] == [2]
    batches = spark.createDataFrame([(1,), (2,)], "conv_id long")
    assert [r.conv_id for r in P.resumable(batches, spark.createDataFrame([(2,), (2,)], "conv_id long")).collect()] == [1]
