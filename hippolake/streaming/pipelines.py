"""Streaming forms of the log operators. Each takes a streaming DataFrame and returns one; the caller starts it.

The log has offsets, not event-time promises: late rows are taken in order of arrival, and watermarks
only bound state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hippolake.sources.tail import growing_lines
from hippolake.storage import remove

#: Events as the log's files hold them.
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def pull(spark: SparkSession, path: str, schema: str = EVENTS, *, file_format: str = "parquet", files: int = 100) -> DataFrame:
    """The log from where the checkpoint left off, so many files at a time."""
    return spark.readStream.schema(schema).format(file_format).option("maxFilesPerTrigger", files).load(path)


def tail_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Messages of prompt and completion events of growing files of JSON lines; other lines and broken ones are left out.

    Each complete line is taken once, from the byte at which the last batch ended; `deduplicated` drops events that were logged twice.
    """
    lines = growing_lines(spark, path)
    kind, body = F.get_json_object("value", "$.type"), F.col("value")
    prompt, answers = F.get_json_object(body, "$.data.prompt"), F.from_json(F.get_json_object(body, "$.data.assistantTexts"), "array<string>")
    text = F.when(kind == "prompt.submitted", prompt).when(kind == "model.completed", F.array_join(answers, "\n"))
    role = F.when(kind == "prompt.submitted", "user").when(kind == "model.completed", "assistant")
    return lines.select(F.get_json_object(body, "$.id").alias("id"), F.try_to_timestamp(F.get_json_object(body, "$.ts")).alias("ts"), role.alias("role"), text.alias("text")).filter("role is not null and text is not null")


def deduplicated(stream: DataFrame, key: str, at: str = "ts", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


#: Where keyed state is kept: in a store of its own per partition, of which a batch reads and writes the keys that it holds.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """For streams started from now on: state lives on disk, and a checkpoint gets what a batch changed, not the whole."""
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)


def latest_state(stream: DataFrame) -> DataFrame:
    """Replays a fact log (fact_id, seq, decay_score): a row per fact that a batch changed, as it is after it: fact_id, seq, decay_score, writes, is_active.

    The latest seq wins, whatever the order of arrival; of equal ones the higher score. State is a fact's last entry and how
    often it was written, so a batch touches its own facts' state only. Null facts are a fact of their own; null seqs are before all others.
    """
    kinds = dict(stream.dtypes)

    def replay(keys: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, score, writes = state.get if state.exists else (None, None, 0)
        rank = lambda s, d: (s is not None, s if s is not None else 0, d is not None, d if d is not None else 0.0)
        for rows in groups:
            for s, d in zip(rows["seq"], rows["decay_score"], strict=True):
                s, d = (None if pd.isna(s) else int(s)), (None if pd.isna(d) else float(d))
                if not writes or rank(s, d) > rank(seq, score):
                    seq, score = s, d
                writes += 1
        state.update((seq, score, writes))
        active = None if score is None else score >= 0.3
        yield pd.DataFrame({"fact_id": pd.array([keys[0]], dtype=object), "seq": pd.array([seq], dtype="Int64"), "decay_score": pd.array([score], dtype="Float64"), "writes": [writes], "is_active": pd.array([active], dtype="boolean")})

    out = f"fact_id {kinds['fact_id']}, seq long, decay_score double, writes long, is_active boolean"
    return stream.groupBy("fact_id").applyInPandasWithState(replay, out, "seq long, decay_score double, writes long", "update", GroupStateTimeout.NoTimeout)


def write_changes(changed: DataFrame, checkpoint: str, target: str, *, batches: int = 64) -> DataStreamWriter:
    """Writes what each batch changed to a folder of its own under `target`; a batch that is replayed writes the same folder again.

    Every `batches` batches the changes so far become one folder that holds each key's latest row, and
    what it replaces goes with the batch after it, so readers merge few folders however long the stream runs.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{target}/changes/epoch={epoch}")
        if epoch and epoch % batches == 0:
            current(spark, target, upto=epoch).write.mode("overwrite").parquet(f"{target}/whole/epoch={epoch}")
        elif epoch > batches and epoch % batches == 1:
            for old in range(epoch - 1 - batches, epoch - 1):
                remove(spark, f"{target}/changes/epoch={old}")
            remove(spark, f"{target}/whole/epoch={epoch - 1 - batches}")

    return changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def current(spark: SparkSession, target: str, *, key: str = "fact_id", upto: int | None = None) -> DataFrame:
    """Each key's latest row of what write_changes has written."""
    def read(kind: str) -> DataFrame | None:
        try:
            return spark.read.option("basePath", f"{target}/{kind}").parquet(f"{target}/{kind}")
        except AnalysisException:  # nothing there yet
            return None

    parts = [part for part in map(read, ("whole", "changes")) if part is not None]
    if not parts:
        raise FileNotFoundError(f"nothing was written to {target}")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if upto is not None:
        rows = rows.filter(F.col("epoch") <= upto)
    columns = [c for c in rows.columns if c not in (key, "epoch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "epoch").alias("row")).select(key, "row.*")


def gap_sessions(stream: DataFrame, gap: str = "30 minutes", *, key: str = "user_id", at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Sessions that a gap of more than `gap` ends; the end is the last event's time, not the window's."""
    windows = stream.withWatermark(at, delay).groupBy(key, F.session_window(at, gap))
    return windows.agg(F.min(at).alias("began"), F.max(at).alias("ended"), F.count("*").alias("events")).drop("session_window")


def turn_trigger(stream: DataFrame, every: int = 3, *, key: str = "conv_id") -> DataFrame:
    """(key, batch): a row for every `every` turns of a conversation, counted across micro-batches."""
    kind = dict(stream.dtypes)[key]

    def count(keys: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, fired = state.get if state.exists else (0, 0)
        seen += sum(len(g) for g in groups)
        due = seen // every
        state.update((seen, due))
        yield pd.DataFrame({key: [keys[0]] * (due - fired), "batch": list(range(fired + 1, due + 1))})

    return stream.groupBy(key).applyInPandasWithState(count, f"{key} {kind}, batch long", "seen long, fired long", "append", GroupStateTimeout.NoTimeout)


def idle_sweep(stream: DataFrame, idle_ms: int, *, key: str = "conv_id") -> DataFrame:
    """(key, turns): a conversation that has been idle for idle_ms of wall clock, once."""
    kind = dict(stream.dtypes)[key]

    def wait(keys: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (turns,) = state.get
            state.remove()
            yield pd.DataFrame({key: [keys[0]], "turns": [turns]})
            return
        turns = (state.get[0] if state.exists else 0) + sum(len(g) for g in groups)
        state.update((turns,))
        state.setTimeoutDuration(idle_ms)

    return stream.groupBy(key).applyInPandasWithState(wait, f"{key} {kind}, turns long", "turns long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def rate_limited(stream: DataFrame, most: int, window: int, *, key: str = "user_id", at: str = "at", name: str = "event_id") -> DataFrame:
    """(key, event_id, allowed): fewer than `most` allowed hits in the `window` seconds before; denied ones don't count.

    State holds at most `most` times a key.
    """
    kinds = dict(stream.dtypes)

    def limit(keys: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(groups)).sort_values([at, name])
        allowed = []
        for t in rows[at].tolist():
            recent = [x for x in recent if x > t - window]
            allowed.append(len(recent) < most)
            if allowed[-1]:
                recent.append(t)
        state.update((recent,))
        yield pd.DataFrame({key: rows[key].to_numpy(), name: rows[name].to_numpy(), "allowed": allowed})

    return stream.groupBy(key).applyInPandasWithState(limit, f"{key} {kinds[key]}, {name} {kinds[name]}, allowed boolean", f"recent array<{kinds[at]}>", "append", GroupStateTimeout.NoTimeout)


def rolling_samples(stream: DataFrame, n: int = 100, *, key: str = "user_id", value: str = "value", order: str = "event_id") -> DataFrame:
    """(key, samples, mean, p95) over the last n samples, after each micro-batch that brings some."""
    kind = dict(stream.dtypes)[key]

    def roll(keys: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(groups)).sort_values(order)
        held = (held + rows[value].tolist())[-n:]
        state.update((held,))
        ordered = sorted(held)
        p95 = ordered[min(int(len(ordered) * 0.95), len(ordered) - 1)]
        yield pd.DataFrame({key: [keys[0]], "samples": [len(held)], "mean": [sum(held) / len(held)], "p95": [p95]})

    return stream.groupBy(key).applyInPandasWithState(roll, f"{key} {kind}, samples long, mean double, p95 double", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def drain(pending: DataFrame, drained: DataFrame, owner: str) -> DataFrame:
    """Messages of an owner that weren't drained yet, in order of arrival."""
    return pending.filter(F.col("owner") == owner).join(drained.select("id"), "id", "left_anti").orderBy("id")


def resumable(batches: DataFrame, registry: DataFrame, key: str = "conv_id") -> DataFrame:
    """What of an import isn't in the registry of conversations already imported."""
    return batches.join(registry.select(key).distinct(), key, "left_anti")
