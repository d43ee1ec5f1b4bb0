"""Exact top-k inner products with Fagin's threshold algorithm.

Vectors become integers, floor(256 x) per component. Candidates are split into blocks; in a block
each dimension has its list of candidates sorted by component. A query reads its dimensions' lists
from the end that helps it, a stretch at a time in all of them, scores every candidate it meets in
full, and stops once the sum of what the lists have come down to can't beat its k-th score. Blocks
answer for themselves, and the best k of their answers are the result.

Queries and candidates meet block by block, in two rounds. In the first each query visits the one
block that its own row would be in. The k-th score found there is a floor: in the second round the
query visits the other blocks with it, leaves those whose lists' heads can't reach it at once, and
stops in the others as soon as their bound falls below it.

Scores are exact whatever the components. Sums that a double holds exactly are taken in doubles;
beyond, doubles with a bound of their error say which candidates may be among the best, and those are
scored with Python's integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hippolake.storage import materialize

#: Sums of integers below this are exact in doubles.
EXACT = float(1 << 53)
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def to_integers(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, v (array<double> of integers) of the rows that take part: an id, a vector, and only components that are finite, also when scaled."""
    v = F.col(vector_col)
    scaled = lambda x: x.cast("double") * scale
    whole = v.isNotNull() & F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(scaled(x)) < float("inf")))
    # A double of 2**53 or more is an integer already; floor gives a long, which needn't hold it.
    rounded = F.transform(v, lambda x: F.when(F.abs(scaled(x)) < EXACT, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    return vectors.filter(whole).select(F.col(id_col).cast("long").alias("vec_id"), rounded.alias("v"))


def product(a: np.ndarray, b: np.ndarray) -> int:
    return sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))


class SortedLists:
    """A block of candidates (doubles of integers) with its per-dimension lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        self.lists = np.argsort(-self.vectors, axis=0, kind="stable").astype(np.int32)  # descending, in each column
        self.most = np.abs(self.vectors).max(axis=0, initial=0)

    def top(self, query_id: int, query: np.ndarray, k: int, floor: float | None = None, stretch: int = 64) -> list[tuple[int, int]]:
        """(vec_id, score) of the k best but the query's own, ties to the smaller id; without those below `floor`, if they are easily left out."""
        n = len(self.ids)
        used = np.flatnonzero(query)
        weights = query[used]
        with np.errstate(over="ignore"):
            largest = float(np.abs(query) @ self.most)
        if not np.isfinite(largest):  # beyond doubles
            return self._best([(int(i), product(v, query)) for i, v in zip(self.ids, self.vectors, strict=True) if i != query_id], k)
        error = 0.0 if largest < EXACT else largest * (len(query) + 2) * 2.0**-52
        # Position p of the list of a negative weight is read from the far end.
        upward = weights < 0
        seen = self.ids == query_id
        rows = np.empty(0, np.int64)  # of candidates that may be among the best, with their scores in doubles
        scores = np.empty(0)
        at = 0
        while at < n:
            span = np.arange(at, min(n, at + stretch))
            places = np.where(upward[None, :], n - 1 - span[:, None], span[:, None])
            heads = self.vectors[self.lists[places[0], used], used] @ weights if len(used) else 0.0
            if floor is not None and heads + error < floor:  # what isn't met yet is below it
                break
            found = self.lists[places, used[None, :]] if len(used) else span
            fresh = np.zeros(n, bool)
            fresh[found.ravel()] = True
            new = np.flatnonzero(fresh & ~seen)
            if len(new):
                seen[new] = True
                rows, scores = np.concatenate([rows, new]), np.concatenate([scores, self.vectors[new] @ query])
                if len(rows) > k:
                    least = np.partition(scores, len(scores) - k)[len(scores) - k]
                    near = scores >= least - 2 * error
                    rows, scores = rows[near], scores[near]
            at += len(span)
            stretch *= 2
            if len(rows) >= k and len(used):
                bound = float(self.vectors[self.lists[places[-1], used], used] @ weights)
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                if least - error > bound + error:  # an equal one could have a smaller id
                    break
            if seen.all():
                break
        if error:
            return self._best([(int(self.ids[r]), product(self.vectors[r], query)) for r in rows], k)
        return self._best([(int(self.ids[r]), int(s)) for r, s in zip(rows, scores, strict=True)], k)

    @staticmethod
    def _best(found: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        return sorted(found, key=lambda x: (-x[1], x[0]))[:k]


def _order_text(score: int) -> str:
    """Text that sorts as the numbers do: length and digits, complemented below zero."""
    digits = str(abs(score))
    return f"1{len(digits):05d}{digits}" if score >= 0 else f"0{99999 - len(digits):05d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def _meet(k: int):
    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        out: list[tuple] = []
        if asks.any() and not asks.all():
            ids = table.column("vec_id").to_numpy()
            v = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            floors = table.column("floor").to_pylist()
            lists = SortedLists(ids[~asks], v[~asks])
            for at in np.flatnonzero(asks).tolist():
                query_id = int(ids[at])
                for i, s in lists.top(query_id, v[at], k, floors[at]):
                    fits = LONG_MIN <= s <= LONG_MAX
                    out.append((query_id, i, s if fits else None, 1 if fits else 2 if s > 0 else 0, None if fits else _order_text(s), None if fits else str(s)))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "vec_id", "score", "side", "order_text", "exact_score"])

    return run


def search(vectors: DataFrame, is_query, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, block_values: int = 1 << 21, most_block: int = 32_768, query_block: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score, exact_score: each query's k best of all rows but its own.

    is_query: a condition on the id. Only vectors of the query's length are scored for it. Rows
    without id, and vectors that are null, empty or hold null or non-finite components (also once
    scaled), take no part. Rows with the query's id are its own; rows that repeat another id are
    candidates each for itself; a query id that occurs with several vectors uses the smallest. Ties go
    to the smaller id. Fewer candidates than k are all returned; an empty table gives no rows. Extra
    columns are not read. Components may be as large as doubles are: the order is exact, and a score
    that a long doesn't hold is null in `score` and written out in `exact_score`, null for others.

    A block holds at most `most_block` candidates and `block_values` components, and is sorted once for
    up to `query_block` queries.
    """
    whole = materialize(to_integers(vectors, id_col=id_col, vector_col=vector_col).withColumn("dims", F.size("v")), "vectors")
    counts = {r["dims"]: (r["n"], r["q"]) for r in whole.groupBy("dims").agg(F.count("*").alias("n"), F.count_if(is_query(F.col("vec_id"))).alias("q")).collect()}
    sizes = [(d, 1 + n // min(most_block, max(256, block_values // d)), 1 + q // query_block) for d, (n, q) in counts.items() if q]
    blocks = whole.sparkSession.createDataFrame(sizes, "dims int, blocks int, query_blocks int")
    rows = whole.join(F.broadcast(blocks), "dims")  # one row per vector length
    dealt = lambda n, *salt: F.pmod(F.xxhash64("vec_id", "v", *salt), F.col(n)).cast("int")
    candidates = rows.select("vec_id", "v", "dims", "query_blocks", dealt("blocks").alias("block"), F.lit(False).alias("asks"), F.lit(None).cast("double").alias("floor"))
    queries = rows.filter(is_query(F.col("vec_id"))).groupBy("dims", "vec_id", "blocks", "query_blocks").agg(F.min("v").alias("v"))
    queries = queries.select("vec_id", "v", "dims", "blocks", dealt("blocks").alias("home"), dealt("query_blocks", F.lit(1)).alias("query_block"), F.lit(True).alias("asks"))
    schema = "query_id long, vec_id long, score long, side int, order_text string, exact_score string"
    columns = ["vec_id", "v", "dims", "block", "query_block", "asks", "floor"]

    def meet(asked: DataFrame, query_blocks) -> DataFrame:
        held = candidates.withColumn("query_block", query_blocks).select(*columns)
        return held.unionByName(asked.select(*columns)).groupBy("dims", "block", "query_block").applyInArrow(_meet(k), schema)

    # Home blocks are few queries' each, so a block's queries are all asked in one group.
    first = materialize(meet(queries.select("*", F.col("home").alias("block"), F.lit(None).cast("double").alias("floor")).withColumn("query_block", F.lit(0)), F.lit(0)), "first")
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("side"), F.desc("score"), F.desc("order_text"), "vec_id"))
    found = first
    if any(b > 1 for _, b, _ in sizes):
        # Doubles may round a floor up, so it is lowered by more than that. Without k scores, or with one beyond longs, there is none.
        floors = first.groupBy("query_id").agg(F.when((F.count("*") >= k) & (F.min("side") == 1), F.min("score") - F.abs(F.min("score")) * 2.0**-50 - 1).alias("floor"))
        again = queries.join(floors, F.col("vec_id") == F.col("query_id"), "left").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).filter("block <> home")
        found = first.unionByName(meet(again, F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1))))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "exact_score")
