"""Packing: shortest-pack-first over the histogram of piece lengths.

A document becomes its token ids and one closing id. It is cut into full sequences and a remainder;
remainders are packed. Only the histogram of lengths (at most `capacity` rows) is seen by the
driver: lengths are placed longest first, each time into the packing patterns with the most room
that still fits it, and only pattern counts are updated. Pieces then find their place by their rank
among the pieces of the same length.
"""

from __future__ import annotations

import os
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hippolake.llm.text import WORD_HASHES
from hippolake.storage import arrow_batches, materialize

#: Rows ranked at once, but for one cell a length.
CELL_ROWS = 1_000
#: Characters of a segment that tiktoken is given.
LONG = 10_000

#: Bytes of a generation of remembered segments, and what an entry takes besides its characters.
MEMO_BYTES, ENTRY_BYTES = 48 << 20, 200
#: Bytes of texts that a worker is handed at once, and of ids that it hands on.
BATCH_BYTES = 4 << 20

#: Per-worker tokenizers by path.
_LOADED: dict[str, "SegmentIds"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class SegmentIds:
    """Token ids as little-endian unsigned 32-bit bytes, by segments that recur.

    A byte-level BPE never merges across a space that stands before a visible character: such a
    space opens a new pre-token. So a text may be cut there, and each distinct segment encoded
    once. Spaces before anything else (blanks, other scripts, the end) are not cut at, which is
    always safe. Segments that don't recur are many, so they are encoded with the file's own
    vocabulary by tiktoken, which is several times faster, where its merges are ranked by their
    ids (as tiktoken takes them to be). Otherwise, and for segments with added tokens in them or of
    more than LONG characters, tokenizers itself is asked: tiktoken's stack and time are not bounded
    on long runs of one class of characters.
    """

    def __init__(self, path: str, limit: int = MEMO_BYTES):
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.fast = _ranked_encoder(self.tokenizer)
        self.cut = re.compile(" (?=[!-~À-ɏ])")
        self.unsafe = re.compile(" (?![!-~À-ɏ])")
        self.inner: dict[str, bytes] = _Memo(lambda s: self._encode(" " + s), limit)
        self.first: dict[str, bytes] = _Memo(self._encode, limit)

    def _encode(self, segment: str) -> bytes:
        if self.fast and len(segment) <= LONG and not self.special.search(segment):
            ids = self.fast(segment)
        else:
            ids = self.tokenizer.encode(segment, add_special_tokens=False).ids
        return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        parts = self.cut.split(text) if self.unsafe.search(text) else text.split(" ")
        return self.first[parts[0]] + b"".join(map(self.inner.__getitem__, parts[1:]))


def _ranked_encoder(tokenizer):
    """tiktoken's encoder for a byte-level BPE whose ids are its merge ranks, or None for any other tokenizer."""
    import json

    import tiktoken
    from tokenizers.pre_tokenizers import ByteLevel

    spec = json.loads(tokenizer.to_str())
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
    if model.get("type") != "BPE" or not plain or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
        return None
    letters = _byte_letters()
    if set(letters.values()) != set(ByteLevel.alphabet()):
        return None
    back = {c: b for b, c in letters.items()}
    vocab, pairs = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    merged = [vocab[a + b] for a, b in pairs]
    if merged != sorted(merged) or len(merged) + 256 > len(vocab) or max((vocab[c] for c in back), default=0) > merged[0]:
        return None
    known = set(merged)
    ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if all(c in back for c in token)}
    ranks = {token: i for token, i in ranks.items() if len(token) == 1 or i in known}
    return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


#: Fixed value: the expression by which byte-level BPE splits a text before merging.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Memo(dict):
    """Values by key, made when first asked for. Two generations of about `limit` bytes bound it: what is asked for again moves to the young one."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.held, self.old = make, limit, 0, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > 64:  # long segments seldom recur
                return value
        if self.held >= self.limit:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[key] = value
        self.held += ENTRY_BYTES + 2 * len(key) + len(value)
        return value


def cut(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Pieces of at most `capacity` ids: doc_id, start, length, doc_tokens, ids (binary, little-endian u32).

    A null or empty text has its closing id only. Repeated rows are cut each for itself; other
    columns of docs are not read, so their names can't clash.
    """
    tokenizer = tokenizer or default_tokenizer()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker may come from an earlier stage: what that left in memory isn't needed beside a vocabulary.
        WORD_HASHES.clear()
        pa.default_memory_pool().release_unused()
        if tokenizer not in _LOADED:
            _LOADED[tokenizer] = SegmentIds(tokenizer)
        encode = _LOADED[tokenizer]
        out: list[list] = [[], [], [], [], []]
        held = 0
        for batch in batches:
            keys = batch.column(0)
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                ids = (encode(text) if text else b"") + end
                key, total = keys[i].as_py(), len(ids) // 4
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    for column, value in zip(out, (key, at // 4, len(part) // 4, total, part), strict=True):
                        column.append(value)
                held += len(ids)
                if held > BATCH_BYTES:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
                    out, held = [[], [], [], [], []], 0
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary")


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Shortest-pack-first: [(lengths in a sequence, number of such sequences)].

    open_[room] holds patterns with that much room left. A length goes to the patterns with the
    most room (the shortest packs); what they can't take opens new sequences.
    """
    open_: dict[int, list[list]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        placed: list[tuple[tuple[int, ...], int]] = []
        while left:
            room = max((r for r, held in open_.items() if held and r >= length), default=None)
            if room is None:
                fits = capacity // length
                if left >= fits:
                    placed.append(((length,) * fits, left // fits))
                if left % fits:
                    placed.append(((length,) * (left % fits), 1))
                left = 0
                break
            pattern, count = open_[room].pop()
            used = min(left, count)
            if count > used:
                open_[room].append([pattern, count - used])
            placed.append((pattern + (length,), used))
            left -= used
        for pattern, count in placed:
            open_.setdefault(capacity - sum(pattern), []).append([pattern, count])
    return [(tuple(p), c) for room in sorted(open_) for p, c in open_[room]]


def slots(packs: list[tuple[tuple[int, ...], int]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, number of ranks, first sequence, offset, padded_to) of each place in each pattern."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, count in packs:
        total, offset = sum(pattern), 0
        for length in pattern:
            out.append((length, taken.get(length, 0), count, sequence, offset, total if total & (total - 1) == 0 else capacity))
            taken[length] = taken.get(length, 0) + count
            offset += length
        sequence += count
    return out


def ranked(pieces: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds `rank` (from 0) among the rows of one key, without bringing a key's rows together.

    Rows are dealt to cells of about CELL_ROWS by a hash; each cell is ranked for itself and starts
    where its key's cells before it end. Rows equal in `order` are told apart by the column `twin`
    (any number), so that a row that is repeated very often isn't one cell's. Cells grow with the
    table, and so are joined, not broadcast.
    """
    sizes = pieces.groupBy(key).agg((1 + F.floor(F.count("*") / CELL_ROWS)).alias("cells"))
    dealt = pieces.join(F.broadcast(sizes), key).withColumn("cell", F.pmod(F.xxhash64(*order, "twin"), F.col("cells")))
    starts = dealt.groupBy(key, "cell").agg(F.count("*").alias("n"))
    before = W.partitionBy(key).orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.select(key, "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    local = F.row_number().over(W.partitionBy(key, "cell").orderBy(*order)) - 1
    return dealt.withColumn("local", local).join(starts, [key, "cell"]).withColumn("rank", F.col("first") + F.col("local")).drop("cell", "cells", "twin", "local", "first")


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, tokenizer: str | None = None, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, padded_to, ids_crc32[, ids].

    Each id lies in exactly one piece; a sequence's offsets leave no gap from 0. A sequence whose
    length is a power of two needs no padding, others are padded to `capacity`. An empty table
    gives no rows; repeated rows are packed as often as they occur. Pieces of one length take places
    in any order, so which of them share a sequence may differ between runs; how long sequences are
    doesn't. Numbers of sequences are unique but leave gaps. Texts of any length, and runs of blanks in them, are encoded whole. keep_ids=False leaves
    the ids out (the checksum stays) for callers that only plan.
    """
    cut_ = cut(docs, id_col=id_col, text_col=text_col, capacity=capacity, tokenizer=tokenizer, end_id=end_id)
    cut_ = cut_.withColumn("ids_crc32", F.crc32("ids"))
    # The number that tells rows apart is written down with them, so it stays the same when they are read twice.
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        pieces = materialize((cut_ if keep_ids else cut_.drop("ids")).withColumn("number", F.monotonically_increasing_id()), "pieces")
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # A full piece, as nearly all of long texts are, has a sequence of its own: no rank is needed, its number will do.
    histogram.pop(capacity, None)
    packs = patterns(histogram, capacity)
    places = spark.createDataFrame(slots(packs, capacity), "length long, first_rank long, ranks long, first_sequence long, offset long, padded_to long")
    full = pieces.filter(F.col("length") == capacity).withColumns({"offset": F.lit(0).cast("long"), "padded_to": F.lit(capacity).cast("long"), "sequence_id": F.lit(sum(n for _, n in packs)) + F.col("number")}).drop("number")
    rest = pieces.filter(F.col("length") < capacity).withColumn("twin", F.col("number") % 4096).drop("number")
    # The number of places depends on the lengths and on how patterns were split, both bounded by capacity squared, whatever the corpus.
    packed = (
        ranked(rest, "length", ["doc_id", "start", "ids_crc32", "doc_tokens"])
        .join(F.broadcast(places), "length")
        .filter((F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("ranks")))
        .withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("first_rank"))
        .drop("rank", "first_rank", "ranks", "first_sequence")
    )
    return packed.unionByName(full)
