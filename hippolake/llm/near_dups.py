"""Near-duplicates by an LSH forest over MinHash signatures.

A text's set is its distinct shingles of `width` words. TREES orders of the texts are kept, each
sorted by a key of UNITS MinHash values. Neighbours that share the first START values of a key are a
region; a region of more than REGION_ROWS texts is divided by the next value, and so on, so depth
adapts to how crowded a region is. Inside a region candidates are compared by size and by a 2-bit
sketch of all values; what passes is confirmed on the full sets.

Large groups of near copies would make very many pairs. So a first pass links each text to a
neighbour before it in a few trees, and finds out which texts have any neighbour alike. Those links are
confirmed and joined to components; a second pass over all trees links each text to one of another
component, and those are confirmed and joined too. In both, what a text is compared with is bounded:
all of its region where that is small, else its nearest neighbours in the order. The last pass
compares all texts of different components that share START values; crowded regions are dealt to
parts of PART_ROWS texts there, and each two parts meet in a task of their own, so no number of
partners or candidates is limited and no region is one task's. Every link that counts was confirmed. In the later passes a profile
of each set (how many of its hashes fall in each of PROFILE cells) bounds what two sets can share
from above, so pairs that the sketch leaves but that can't be similar enough aren't joined to their sets.

Texts with equal sets are one node (by two 64-bit sums over the set), whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, CalendarIntervalType, DataType, MapType, StructType, VariantType

from hippolake.llm.components import components
from hippolake.llm.text import WORD, WORD_HASHES, mix64, shingle_hashes, words_of
from hippolake.storage import materialize

TREES, UNITS, START = 16, 8, 3
VALUES = TREES * UNITS
REGION_ROWS = 512
#: Neighbours in the order with which a text of a more crowded region is compared.
NEIGHBOURS = 8
#: Rows that a worker takes in before it hands on what they say.
HELD_ROWS = 20_000
#: Texts of a part of a crowded region in the last pass.
PART_ROWS = 8192
#: Regions of about so many texts are dealt to several tasks in the first passes; a sample of one in SAMPLE texts says which. It only spreads the work.
WIDE_ROWS, SAMPLE = 200_000, 64
#: Candidate pairs that a worker gathers before it hands them on.
HELD_PAIRS = 1_000_000
#: Trees whose neighbours are linked before components are known.
FIRST_TREES = 3
#: Cells of a set's profile, a byte each; a fuller cell counts as bounding nothing.
PROFILE = 1024
#: Equal 2-bit fields of 128 that a pair must have: five standard deviations below what 0.8 similar sets have on average.
SKETCH_LEAST = 89

_rng = np.random.default_rng(11)
_XOR = _rng.integers(0, 1 << 64, VALUES, np.uint64)
_ODD = _rng.integers(0, 1 << 63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; empty without words."""
    words = words_of(text)
    return shingle_hashes(WORD_HASHES.of(words), width) if words else np.empty(0, np.uint64)


def signature(found: np.ndarray) -> np.ndarray:
    """VALUES MinHash values of a non-empty set, mixed, so that any of their bits will do."""
    least = np.full(VALUES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(found), 2048):
        np.minimum(least, ((found[at : at + 2048, None] ^ _XOR) * _ODD).min(axis=0), out=least)
    return mix64(least)


def set_key(found: np.ndarray) -> bytes | None:
    """128 bits that equal sets share; None for an empty one."""
    if not len(found):
        return None
    sums = [np.add.reduce(mix64(found ^ np.uint64(salt))) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return mix64(np.array(sums, np.uint64)).astype("<u8").tobytes()


def _marks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, sketches, trees = [], [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py(), width)
                counts.append(len(found))
                if not len(found):
                    keys.append(None), sketches.append(None), trees.append(None)
                    continue
                values = signature(found)
                keys.append(set_key(found))
                trees.append(values.astype(np.uint16).astype(">u2").tobytes())
                fields = ((values >> np.uint64(16)) & np.uint64(3)).reshape(4, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))
                sketches.append(np.bitwise_or.reduce(fields, axis=1).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), pa.array(trees, pa.binary())], ["doc_id", "text_key", "n_shingles", "set_key", "sketch", "trees"])

    return run


def profile(found: np.ndarray) -> bytes:
    """Hashes of the set per cell, 255 for that many or more."""
    return np.minimum(np.bincount((found >> np.uint64(40)).astype(np.int64) % PROFILE, minlength=PROFILE), 255).astype(np.uint8).tobytes()


def most_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An upper bound of what the sets with profiles a and b (rows) share; without bound if a cell of both is full."""
    least = np.minimum(a, b)
    return np.where((least == 255).any(axis=1), np.int64(1) << 40, least.sum(axis=1, dtype=np.int64))


def _sets(width: int):
    """Rows of one node come one after the other, and give its set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            nodes = batch.column("node").to_pylist()
            fresh = [i for i, n in enumerate(nodes) if n != (nodes[i - 1] if i else last)]
            last = nodes[-1] if nodes else last
            texts = batch.column("text")
            found = [shingles(texts[i].as_py(), width).view(np.int64) for i in fresh]
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in fresh], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([profile(f.view(np.uint64)) for f in found], pa.binary())], ["node", "members", "profile"])

    return run


def _fixed(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    """A binary column whose values have one length, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, 1), kind)
    first, last = (int(x) for x in np.frombuffer(column.buffers()[1], np.int32)[[column.offset, column.offset + len(column)]])
    return np.frombuffer(column.buffers()[2], np.uint8)[first:last].view(kind).reshape(len(column), -1)


class _Region:
    """Rows in order, with columns as numpy arrays."""

    def __init__(self, table: pa.Table, percent: int):
        column = lambda c: table.column(c).to_numpy() if c in table.column_names else None
        self.tree, self.node, self.size = column("tree"), column("node"), column("n_shingles")
        self.key, self.sketch = _fixed(table.column("key"), ">u2"), _fixed(table.column("sketch"), "<u8")
        self.label, self.wide = column("label"), column("wide")
        self.part, self.p, self.q = column("part"), column("p"), column("q")
        self.profile = _fixed(table.column("profile"), np.uint8) if "profile" in table.column_names else None
        self.percent = percent

    def edges(self) -> list[int]:
        """Where regions begin, and the end."""
        changes = (self.tree[1:] != self.tree[:-1]) | (self.key[1:, :START] != self.key[:-1, :START]).any(axis=1)
        for deal in (self.p, self.q):
            if deal is not None:
                changes |= deal[1:] != deal[:-1]
        return [0, *(np.flatnonzero(changes) + 1).tolist(), len(self.node)]

    def alike(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Which pairs may be similar enough by size and sketch: of two arrays of one shape, or of a column and a row of indices."""
        differ = 0
        for word in range(self.sketch.shape[1]):
            x = self.sketch[rows, word] ^ self.sketch[others, word]
            differ = differ + np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555))
        a, b = self.size[rows], self.size[others]
        return (differ <= VALUES - SKETCH_LEAST) & (100 * np.minimum(a, b) >= self.percent * np.maximum(a, b))

    def possible(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs may reach the share by their profiles."""
        ok = np.empty(len(i), bool)
        for at in range(0, len(i), 4096):
            x, y = i[at : at + 4096], j[at : at + 4096]
            shared = np.minimum(most_shared(self.profile[x], self.profile[y]), np.minimum(self.size[x], self.size[y]))
            ok[at : at + 4096] = 100 * shared >= self.percent * (self.size[x] + self.size[y] - shared)
        return ok

    def pairs(self, low: int, high: int, how: str) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Candidate pairs among the rows low..high, each compared with each, and whether they are to be linked.

        first: for each row one before it, to be linked, and one after it, which only says that both
        have candidates. other: for each row one of another label.
        """
        for at in range(low, high, 256):
            rows = np.arange(at, min(at + 256, high))
            for start in range(low, high, 1024):
                others = np.arange(start, min(start + 1024, high))
                ok = self.alike(rows[:, None], others[None, :])
                if how == "first":
                    before, after = ok & (others[None, :] < rows[:, None]), ok & (others[None, :] > rows[:, None])
                    for side, first in ((before, True), (after, False)):
                        hit = side.any(axis=1)
                        yield rows[hit], others[side.argmax(axis=1)[hit]], first
                    continue
                ok &= self.label[rows][:, None] != self.label[others][None, :]
                i, j = np.nonzero(ok)
                i, j = rows[i], others[j]
                kept = self.possible(i, j)
                i, first = np.unique(i[kept], return_index=True)
                yield i, j[kept][first], True

    def neighbours(self, low: int, high: int, how: str) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """The same, of each row with the NEIGHBOURS before it.

        first: rows of so crowded a region are all taken to have candidates, so each is also paired with itself.
        """
        if how == "first":
            yield np.arange(low, high), np.arange(low, high), False
        free = np.ones(high - low, bool)
        for step in range(1, min(NEIGHBOURS, high - low - 1) + 1):
            rows = np.arange(low + step, high)
            rows = rows[free[step:]]
            ok = self.alike(rows, rows - step)
            if how != "first":
                ok &= self.label[rows] != self.label[rows - step]
                ok[ok] = self.possible(rows[ok], rows[ok] - step)
            rows = rows[ok]
            free[rows - low] = False
            yield rows, rows - step, True

    def across(self, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Every pair of different labels among the rows low..high that size, sketch and profile leave; of two parts, if they are rows of two.

        Rows go label by label, and labels by their smallest set: what has one label isn't compared
        with itself, and rows of one block have sizes close to each other.
        """
        names, which = np.unique(self.label[low:high], return_inverse=True)
        least = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(least, which, self.size[low:high])
        rank = np.empty(len(names), np.int64)
        rank[np.lexsort((names, least))] = np.arange(len(names))
        place = rank[which]
        order = np.lexsort((self.size[low:high], place))
        place, order = place[order], order + low
        size, part = self.size[order], self.part[order]
        apart = self.p[low] != self.q[low]
        for at in range(0, len(order), 256):
            rows, held = order[at : at + 256], size[at : at + 256]
            after = np.arange(np.searchsorted(place, place[at], side="right"), len(order))
            after = after[(100 * size[after] >= self.percent * held.min()) & (self.percent * size[after] <= 100 * held.max())]
            for start in range(0, len(after), 1024):
                others = after[start : start + 1024]
                ok = self.alike(rows[:, None], order[others][None, :]) & (place[at : at + 256][:, None] < place[others][None, :])
                if apart:
                    ok &= part[at : at + 256][:, None] != part[others][None, :]
                i, j = np.nonzero(ok)
                i, j = rows[i], order[others[j]]
                kept = self.possible(i, j)
                yield i[kept], j[kept], True


def _regions(percent: int, how: str):
    """Streams rows in order; yields candidate pairs (a, b, tree) of nodes, with tree TREES for those not to be linked first."""

    def split(r: _Region, low: int, high: int, depth: int) -> Iterator[tuple[int, int]]:
        if high - low < 2:
            return
        if high - low <= REGION_ROWS or depth == UNITS:
            yield low, high
            return
        cuts = np.flatnonzero(r.key[low + 1 : high, depth] != r.key[low : high - 1, depth]) + low + 1
        edges = [low, *cuts.tolist(), high]
        for a, b in zip(edges, edges[1:], strict=False):
            yield from split(r, a, b, depth + 1)

    def compared(r: _Region, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        if how == "all":
            yield from r.across(low, high)
            return
        if high - low > REGION_ROWS or r.wide[low]:
            yield from r.neighbours(low, high, how)
        for a, b in split(r, low, high, START):
            if b - a <= REGION_ROWS:
                yield from r.pairs(a, b, how)

    def handle(r: _Region, end: int) -> Iterator[pa.RecordBatch]:
        edges = [e for e in r.edges() if e < end] + [end]
        found: list[tuple[np.ndarray, np.ndarray, bool]] = []
        held = 0
        for low, high in zip(edges, edges[1:], strict=False):
            for some in compared(r, low, high):
                found.append(some)
                held += len(some[0])
                if held >= HELD_PAIRS:
                    yield from told(r, found)
                    found, held = [], 0
        yield from told(r, found)

    def told(r: _Region, found: list[tuple[np.ndarray, np.ndarray, bool]]) -> Iterator[pa.RecordBatch]:
        i = np.concatenate([x for x, _, _ in found]) if found else np.empty(0, np.int64)
        j = np.concatenate([y for _, y, _ in found]) if found else np.empty(0, np.int64)
        linked = np.concatenate([np.full(len(x), f) for x, _, f in found]) if found else np.empty(0, bool)
        a, b = r.node[i], r.node[j]
        made = pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "tree": np.where(linked, r.tree[i], TREES).astype(np.int32)}).group_by(["a", "b"]).aggregate([("tree", "min")])
        yield from pa.table({"a": made.column("a"), "b": made.column("b"), "tree": made.column("tree_min")}).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < HELD_ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            r = _Region(table, percent)
            end = r.edges()[-2]
            keep = rows - end
            crowded = how != "all" and not end  # its rows need no more than the neighbours before them
            if crowded:
                end, keep = rows, NEIGHBOURS
            if end:
                yield from handle(r, end)
                rest = table.slice(table.num_rows - keep)
                if crowded:  # and so does what follows of it, however little that is
                    rest = rest.set_column(rest.schema.get_field_index("wide"), "wide", pa.array([True] * keep))
                held, rows = rest.combine_chunks().to_batches(), keep
        if held:
            r = _Region(pa.Table.from_batches(held).combine_chunks(), percent)
            yield from handle(r, len(r.node))

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets share at least percent of their union."""
    left = sets.select(F.col("node").alias("left_node"), F.col("members").alias("of_a"))
    right = sets.select(F.col("node").alias("right_node"), F.col("members").alias("of_b"))
    met = pairs.select("a", "b").distinct().join(left, F.col("a") == F.col("left_node")).join(right, F.col("b") == F.col("right_node"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return met.withColumn("shared", shared).filter(100 * F.col("shared") >= percent * (F.size("of_a") + F.size("of_b") - F.col("shared"))).select("a", "b").distinct()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("text_key"))


def _labelled(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """marks: a row per row of docs with its set_key. nodes: set_key, first (missing, doc_id, text_key of its first row), label of its component."""
    texts = _texts(docs, id_col, text_col)
    marks = materialize(texts.mapInArrow(_marks(width), "doc_id long, text_key binary, n_shingles long, set_key binary, sketch binary, trees binary"), "marks")

    # Nodes: distinct sets, numbered as they are written down. What belongs to a set is the same in all its rows.
    row = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_key")
    nodes = marks.filter("n_shingles > 0").groupBy("set_key").agg(F.min(row).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("trees").alias("trees"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    entries = nodes.select("node", "n_shingles", "sketch", "trees", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    key = F.substr("trees", F.col("tree") * (2 * UNITS) + 1, F.lit(2 * UNITS))
    entries = entries.select(F.col("tree").cast("int").alias("tree"), key.alias("key"), "node", "n_shingles", "sketch")
    region = [F.col("tree"), F.substr("key", F.lit(1), F.lit(2 * START))]
    entries = _dealt(entries, nodes, region)
    in_order = lambda df, *more: df.repartition(*region, *more).sortWithinPartitions("tree", *([region[1]] if more else []), *more, "key", "node")
    schema = "a long, b long, tree int"

    near = materialize(in_order(entries, "deal").mapInArrow(_regions(percent, "first"), schema), "near")
    touched = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = nodes.join(touched, "node", "left_semi").select("node", F.col("first.doc_id").alias("of_id"), F.col("first.text_key").alias("of_key"))
    # One row's text for each node: copies of it have other ids. The wanted grow with the corpus, so they are not broadcast, however few they are in a small one.
    held = texts.join(wanted.hint("merge"), (F.col("text_key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of_id")))
    sets = materialize(held.select("node", "text").mapInArrow(_sets(width), "node long, members array<bigint>, profile binary"), "sets")

    links = materialize(confirmed(near.filter((F.col("tree") < FIRST_TREES) & (F.col("a") != F.col("b"))), sets, percent), "confirmed")
    labels = materialize(components(links), "labels")
    profiles = sets.select("node", "profile")
    for how in ("other", "all"):
        # Regions within one component have nothing more to say.
        bare = entries.join(profiles.select("node"), "node", "left_semi").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = bare.groupBy(region[0].alias("t"), region[1].alias("k")).agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).filter("low < high").select("t", "k", "n", (1 + F.floor(F.col("n") / PART_ROWS)).cast("int").alias("parts"))
        again = bare.join(mixed, (region[0] == F.col("t")) & (region[1] == F.col("k"))).drop("t", "k").join(profiles, "node")
        if how == "other":  # now counted: what is too crowded to compare all with all is dealt to several tasks
            crowded = F.col("n") > 2 * REGION_ROWS
            again = again.withColumn("wide", crowded).withColumn("deal", F.when(crowded, F.pmod(F.xxhash64("node"), F.floor(F.col("n") / REGION_ROWS))).otherwise(0).cast("int"))
        else:
            # Each two parts of a region meet: a row goes to one group for each part.
            again = again.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            again = again.withColumn("p", F.least("part", "meets")).withColumn("q", F.greatest("part", "meets")).drop("meets")
        # Written down first: the planner drops a repartition that a join just made, and adaptive execution may then
        # undo the join's own exchange, which would tear regions apart.
        again = materialize(again.drop("parts", "n"), "again")
        found = materialize(in_order(again, *(("p", "q") if how == "all" else ("deal",))).mapInArrow(_regions(percent, how), schema), how)
        links = materialize(links.unionByName(confirmed(found, sets, percent)), "confirmed")
        labels = materialize(components(links), "labels")
    return marks, nodes.select("set_key", "first", "node").join(labels, "node", "left").select("set_key", "first", F.coalesce("label", "node").alias("label"))


def _dealt(entries: DataFrame, nodes: DataFrame, region: list) -> DataFrame:
    """entries with `wide` and `deal`: regions that a sample finds very crowded are dealt to several tasks, others to one.

    How rows are dealt changes what they are compared with in the first two passes, not what the last one finds.
    """
    if nodes.count() < WIDE_ROWS:
        return entries.withColumn("wide", F.lit(False)).withColumn("deal", F.lit(0))
    sample = entries.filter(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(SAMPLE)) == 0)
    crowded = sample.groupBy(region[0].alias("t"), region[1].alias("k")).count().filter(F.col("count") * SAMPLE >= WIDE_ROWS)
    crowded = materialize(crowded.select("t", "k", (F.col("count") * SAMPLE * 4 / WIDE_ROWS).cast("int").alias("deals")), "crowded")
    met = entries.join(crowded, (region[0] == F.col("t")) & (region[1] == F.col("k")), "left")
    return met.withColumn("wide", F.col("deals").isNotNull()).withColumn("deal", F.when(F.col("wide"), F.pmod(F.xxhash64("node"), F.col("deals"))).otherwise(0).cast("int")).drop("t", "k", "deals")


def group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked if their shingle sets share at least `percent` of their union (exactly: 100
    shared >= percent union). component_id is the smallest doc_id connected to it, itself included;
    kept says that it is the document's own. Without words (or text) n_shingles is 0 and the document
    stands alone. Rows without doc_id link like others but name no component: among themselves it is
    null, and all are kept. Repeated rows have one set and so one component, and are kept together.
    Sets are of whole texts, however long. Extra columns are not read; an empty table gives no rows.
    """
    marks, nodes = _labelled(docs, id_col, text_col, width, percent)
    component = nodes.groupBy("label").agg(F.min("first.doc_id").alias("component"))
    named = marks.select("doc_id", "n_shingles", "set_key").join(nodes.join(component, "label").select("set_key", "component"), "set_key", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return named.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def _has_order(kind: DataType) -> bool:
    """Whether Spark can order values of this type; it can't order maps, intervals of calendars and variants."""
    if isinstance(kind, StructType):
        return all(_has_order(f.dataType) for f in kind)
    if isinstance(kind, ArrayType):
        return _has_order(kind.elementType)
    return not isinstance(kind, (MapType, CalendarIntervalType, VariantType))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest id, without id last, then by its text's digest.

    Components are of texts, not of ids: rows that share an id, or have none, are each judged by their
    own text. Rows with equal id and text are one document, of which the one with the smallest other
    columns stays. Rows without words are linked with nothing, so all of them stay. Columns keep their
    names and order, whatever they are called; an empty table gives no rows.
    """
    _, nodes = _labelled(docs, id_col, text_col, width, percent)
    best = nodes.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("best_id"), F.col("first.text_key").alias("best_key"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(text)).alias("key"), text.rlike(WORD).alias("worded"))
    # Rows are ordered by the columns that have an order, then by the others written as JSON.
    ordered, others = [], []
    for field in docs.schema:
        (ordered if _has_order(field.dataType) else others).append(F.col("row")[field.name])
    by = F.struct(*[c.alias(f"c{i}") for i, c in enumerate([*ordered, *([F.to_json(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(others)]))] if others else [])])])
    one = rows.filter("worded").groupBy("id", "key").agg(F.min_by("row", by).alias("row"))
    stay = one.join(best.hint("merge"), F.col("id").eqNullSafe(F.col("best_id")) & (F.col("key") == F.col("best_key")), "left_semi")
    return stay.select("row.*").unionByName(rows.filter(~F.col("worded")).select("row.*"))
