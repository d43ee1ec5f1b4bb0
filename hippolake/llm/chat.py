r"""Chat formatting by columnar byte assembly.

The template of a turn is `### role: text</turn>\n`. Inside role and text every backslash, # and <
is preceded by a backslash, in a role the colon too, so no text can look like a mark and the output
reads back exactly. A block of rows is assembled at once: segment lengths give cumulative offsets,
those the place of every byte, and headers and contents are scattered into one preallocated buffer
that Arrow takes as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = b"### ", b": ", b"</turn>\n"
BACKSLASH = ord("\\")
SCHEMA = "conv_id long, formatted string, loss_spans array<struct<start:bigint,end:bigint>>"
#: Bytes of text assembled at once, unless one conversation has more.
BLOCK_BYTES = 4 << 20

_TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.)*+)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


class _Escaped:
    """A column's bytes, with where each goes once escapes are in."""

    def __init__(self, column: pa.Array, marks: bytes):
        column = column.cast(pa.large_binary())
        first, last = column.offset, column.offset + len(column)
        starts = np.frombuffer(column.buffers()[1], np.int64)[first : last + 1]
        data = column.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data else np.empty(0, np.uint8)
        starts = starts - starts[0]
        self.marked = np.isin(self.bytes, np.frombuffer(marks, np.uint8))
        before = np.concatenate(([0], np.cumsum(self.marked)))
        self.lengths = np.diff(starts) + np.diff(before[starts])
        self.rows = np.repeat(np.arange(len(column)), np.diff(starts))
        self.within = np.arange(len(self.bytes)) - starts[self.rows] + before[1:] - before[starts[self.rows]]

    def scatter(self, out: np.ndarray, at: np.ndarray) -> None:
        to = at[self.rows] + self.within
        out[to] = self.bytes
        out[to[self.marked] - 1] = BACKSLASH


def assemble(conv: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """The buffer of all turns; per conversation its end; per assistant turn its conversation and span in characters of it.

    conv: number of each row's conversation, ascending from 0.
    """
    role, text = _Escaped(roles, b"\\#<:"), _Escaped(texts, b"\\#<")
    n = len(conv)
    role_at = len(OPEN)
    lengths = len(OPEN) + role.lengths + len(MIDDLE) + text.lengths + len(CLOSE)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    middle = starts + role_at + role.lengths
    body = middle + len(MIDDLE)
    for mark, at in ((OPEN, starts), (MIDDLE, middle), (CLOSE, body + text.lengths)):
        out[at[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    role.scatter(out, starts + role_at)
    text.scatter(out, body)
    conv_ends = ends[np.flatnonzero(np.diff(conv, append=conv[-1] + 1 if n else 0))] if n else ends
    characters = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))
    loss = np.flatnonzero(np.array(roles.to_pylist(), object) == "assistant")
    base = characters[np.concatenate(([0], conv_ends))[conv[loss]]]
    spans = np.stack([characters[body[loss]] - base, characters[(body + text.lengths)[loss]] - base], 1) if n else np.empty((0, 2), np.int64)
    return pa.py_buffer(out), conv_ends, conv[loss], spans


def _block(table: pa.Table) -> pa.RecordBatch:
    ids = table.column("conv_id").combine_chunks()
    keys = np.array(ids.to_pylist(), object)
    conv = np.cumsum(np.concatenate(([False], keys[1:] != keys[:-1])))
    as_text = lambda c: table.column(c).combine_chunks().fill_null("")
    buffer, ends, owners, spans = assemble(conv, as_text("role"), as_text("text"))
    count = len(ends)
    if len(buffer) >= 1 << 31:
        raise ValueError("a conversation of 2 GB or more doesn't fit in one row")
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    formatted = pa.StringArray.from_buffers(count, pa.py_buffer(offsets), buffer)
    per_conv = np.concatenate(([0], np.cumsum(np.bincount(owners, minlength=count)))).astype(np.int32)
    pair = pa.StructArray.from_arrays([pa.array(spans[:, 0], pa.int64()), pa.array(spans[:, 1], pa.int64())], ["start", "end"])
    first = np.flatnonzero(np.diff(conv, prepend=-1))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), formatted, pa.ListArray.from_arrays(pa.array(per_conv), pair)], ["conv_id", "formatted", "loss_spans"])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive by conversation; a block ends where a conversation does."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.nbytes for b in held) < BLOCK_BYTES:
            continue
        table = pa.Table.from_batches(held)
        ids = table.column("conv_id").to_pylist()
        last = next((i for i in range(len(ids) - 1, 0, -1) if ids[i] != ids[i - 1]), 0)
        if last:
            yield _block(table.slice(0, last))
            held = table.slice(last).to_batches()
    if held:
        yield _block(pa.Table.from_batches(held))


def format_chats(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (characters of the assistant turns' escaped texts).

    Turns are ordered by turn, nulls first; turns of one number by role, then text; repeated rows
    are repeated turns. Null roles and texts are empty. Rows without conv_id make one conversation.
    Extra columns are not read; an empty table gives no rows. A conversation is one row of the
    result, so it must fit in a task's memory and in 2 GB.
    """
    taken = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    sorted_ = taken.repartition("conv_id").sortWithinPartitions(*order).drop("turn")
    return sorted_.mapInArrow(_run, SCHEMA)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say when read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    import hashlib

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, text, spans in zip(*(batch.column(c) for c in ("conv_id", "formatted", "loss_spans")), strict=True):
                text = text.as_py()
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans.as_py())
                out.append((conv_id.as_py(), len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
