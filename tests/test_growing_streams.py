"""Streams over files that grow, and keyed state, across restarts."""

from __future__ import annotations

import json

import pytest

from hippolake.sources import tail
from hippolake.streaming import pipelines as P


def run(frame, checkpoint, target):
    frame.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start().awaitTermination(120)


def test_each_line_once_across_restarts(spark, tmp_path):
    logs, checkpoint, target = tmp_path / "logs", str(tmp_path / "c"), str(tmp_path / "t")
    logs.mkdir()
    (logs / "a.jsonl").write_bytes(b"one\ntwo\r\nthr")
    (logs / ".hidden").write_bytes(b"never\n")
    run(tail.growing_lines(spark, str(logs)), checkpoint, target)
    assert sorted(r.value for r in spark.read.parquet(target).collect()) == ["one", "two"]
    with open(logs / "a.jsonl", "ab") as file:
        file.write("ee\n\né\nfo".encode())
    (logs / "b.jsonl").write_bytes(b"\xff\nx\n")
    run(tail.growing_lines(spark, str(logs)), checkpoint, target)
    run(tail.growing_lines(spark, str(logs)), checkpoint, target)  # nothing new
    rows = spark.read.parquet(target).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.offset, r.value) for r in rows) == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two"), ("a.jsonl", 9, "three"), ("a.jsonl", 15, ""), ("a.jsonl", 16, "é"), ("b.jsonl", 0, "�"), ("b.jsonl", 2, "x")]


@pytest.mark.parametrize("part", [1, 2, 3, 7, 1000])
def test_parts_share_no_line_and_lose_none(tmp_path, part):
    path = tmp_path / "x"
    lines = [b"", b"a", b"bc", b"", b"defghij", b"k" * 20, b""]
    path.write_bytes(b"".join(line + b"\n" for line in lines) + b"open")
    reader = tail.GrowingLinesReader({"path": str(path), "partbytes": str(part)})
    for start in (0, 1, 3):
        found = [x for p in reader.partitions({str(path): start} if start else {}, reader.latestOffset()) for x in reader.read(p)]
        whole = [(at, line.decode()) for at, line in zip([sum(len(x) + 1 for x in lines[:i]) for i in range(len(lines))], lines, strict=True)]
        assert [(at, value) for _, at, value in found] == [w for w in whole if w[0] >= start]


def test_ends_of_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "LOOK_BYTES", 4)
    path = tmp_path / "x"
    for content, ended in ((b"", 0), (b"abcdefghij", 0), (b"a\nbcdefghijkl", 2), (b"a\n", 2), (b"0123456789\n", 11)):
        path.write_bytes(content)
        assert tail.ended_bytes(str(path)) == ended
    path.write_bytes(b"x\n")
    assert tail.ended_bytes(str(path), 11) == 2  # written anew


def test_messages_of_a_growing_log(spark, tmp_path):
    logs, checkpoint, target = tmp_path / "logs", str(tmp_path / "c"), str(tmp_path / "t")
    logs.mkdir()
    line = lambda i: json.dumps({"id": str(i), "ts": "2024-01-01T00:00:00Z", "type": "prompt.submitted", "data": {"prompt": f"p{i}"}})
    for i in range(3):
        with open(logs / "a.jsonl", "a") as file:
            file.write(f"{line(i)}\nbroken\n{line(i + 1)[:20]}" if not i else f"{line(i)[20:]}\n{line(i + 1)[:20]}")
        run(P.tail_jsonl(spark, str(logs)), checkpoint, target)
    assert sorted(r.text for r in spark.read.parquet(target).collect()) == ["p0", "p1", "p2"]


def entries(spark, folder, rows):
    spark.createDataFrame(rows, "fact_id long, seq long, decay_score double").coalesce(1).write.mode("append").parquet(folder)


def test_state_is_kept_per_key_across_restarts(spark, tmp_path):
    log, checkpoint, target = str(tmp_path / "log"), str(tmp_path / "c"), str(tmp_path / "t")
    P.keep_state_in_rocksdb(spark)

    def go():
        stream = P.latest_state(P.pull(spark, log, "fact_id long, seq long, decay_score double"))
        query = P.write_changes(stream, checkpoint, target, batches=2).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return query.lastProgress["stateOperators"][0]

    try:
        entries(spark, log, [(i, 1, 0.5) for i in range(500)] + [(None, 1, 0.2)])
        assert go()["numRowsUpdated"] == 501
        entries(spark, log, [(i, 3 if i % 2 else 0, 0.1) for i in range(10)] + [(3, 3, 0.9), (4, None, 0.9)])
        state = go()
        assert (state["numRowsTotal"], state["numRowsUpdated"]) == (501, 10)  # the others' state isn't touched
        for seq in (5, 6, 7):
            entries(spark, log, [(1, seq, 0.3)])
            assert go()["numRowsUpdated"] == 1
        rows = {r.fact_id: (r.seq, r.decay_score, r.writes, r.is_active) for r in P.current(spark, target).collect()}
        assert len(rows) == 501 and rows[None] == (1, 0.2, 1, False) and rows[1] == (7, 0.3, 5, True)
        assert rows[2] == (1, 0.5, 2, True) and rows[3] == (3, 0.9, 3, True) and rows[4] == (1, 0.5, 3, True) and rows[499] == (1, 0.5, 1, True)
        assert len([p for p in (tmp_path / "t" / "changes").iterdir() if p.name.startswith("epoch=")]) <= 4
    finally:
        for name in P.STATE_STORE:
            spark.conf.unset(name)
