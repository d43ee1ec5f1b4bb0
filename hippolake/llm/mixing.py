"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is cut into blocks of about `block_words` words by a keyed hash. Blocks are drawn
whole in permuted order until the source's target is met; only the block in which the target falls
is drawn by document. The drawn blocks of all sources are then dealt to output shards: a binary tree
over the shards splits the vector of block counts exactly, each split a multivariate hypergeometric
draw, and shards take disjoint runs of each source's permuted blocks. Within a shard, documents are
ordered by another keyed hash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hippolake.llm.text import word_count
from hippolake.storage import materialize

#: The weights of the sources in order, repeated.
WEIGHTS = (5, 2, 1)
#: Words of an output shard, about.
SHARD_WORDS = 2_000_000
#: Numbers of the table of sources and shards that the driver splits; shards grow beyond SHARD_WORDS to keep to it.
MOST_QUOTAS = 4_000_000
#: Sources that the driver plans for; more are refused.
MOST_SOURCES = 500_000


def targets(sizes: list[int], weights: list[int], total: int, most: int = 3) -> list[float]:
    """Shares of `total` by weight, none above `most` times its size, the excess reshared by weight."""
    open_ = [i for i, n in enumerate(sizes) if n > 0]
    out = [0.0] * len(sizes)
    left = total
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * left > most * sizes[i] * weight]
        if not full:
            for i in open_:
                out[i] = weights[i] * left / weight
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= most * sizes[i]
        open_ = [i for i in open_ if i not in full]
    return out


def split(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """counts[source] dealt to shards: rows are shards, column sums are exactly counts."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((shards, len(counts)), np.int64)
    todo = [(0, shards, np.asarray(counts, np.int64))]
    while todo:
        low, high, have = todo.pop()
        if high - low == 1:
            out[low] = have
            continue
        middle = (low + high) // 2
        size = int(have.sum()) * (middle - low) // (high - low)
        left = rng.multivariate_hypergeometric(have, size, method="marginals") if len(have) else have
        todo += [(low, middle, left), (middle, high, have - left)]
    return out


def _keyed(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", payload: list[str] | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = 3, block_words: int = 200_000, shards: int | None = None, seed: int = 7) -> DataFrame:
    """Every row of docs with what the mix takes of it.

    Columns: doc_id, source, size, source_size, target, copies, shards (one per copy), order_key,
    and the `payload` columns of docs as a struct. Sources are weighed in code point order, null
    last; a source without words has target 0. Null and blank texts have size 0 and are drawn with
    their block. Repeated rows are drawn each for itself;
    extra columns are not read. An empty table gives an empty plan. The same rows give the same
    plan, however they are partitioned.

    What a document gives is what the shards draw of its block: the splitting tree's quotas say how
    many of a source's units (a block, as often as the mix repeats it) each shard has, shards take them
    in permuted order, and `copies` counts the units that went to one.

    The driver sees one row per source and one per source and shard. Shards follow from the words of
    the mix (about SHARD_WORDS each) unless their number is given. More than MOST_SOURCES sources are
    refused with an error: sites, say, are to be grouped first.
    """
    spark = docs.sparkSession
    kept = F.struct(*[F.col(f"`{c}`") for c in payload]) if payload else F.lit(None).cast("struct<none:int>")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.md5(F.col(text_col)).alias("digest"), kept.alias("payload"))
    rows = rows.withColumn("order_key", _keyed(seed, F.col("doc_id"), F.col("size"), F.col("digest"))).drop("digest")
    rows = materialize(rows, "sized") if not payload else rows

    found = sorted(rows.groupBy("source").agg(F.sum("size").alias("n")).collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    if len(found) > MOST_SOURCES:
        raise ValueError(f"{len(found)} sources are more than {MOST_SOURCES}")
    sizes = [r["n"] for r in found]
    shards = shards or max(1, min(math.ceil(sum(sizes) / SHARD_WORDS), MOST_QUOTAS // max(1, len(found))))
    goals = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], sum(sizes), most)
    source_plan = []
    for row, goal in zip(found, goals, strict=True):
        n = row["n"]
        whole = int(goal // n) if n else 0
        source_plan.append((row["source"], n, goal, whole, goal - whole * n, max(1, math.ceil(n / block_words))))
    by_source = spark.createDataFrame(source_plan, f"source {dict(rows.dtypes)['source']}, source_size long, target double, whole int, rest double, blocks int")

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    placed = rows.join(by_source, same(rows, by_source)).drop(by_source["source"])
    placed = placed.withColumn("block", F.pmod(F.conv(F.substring("order_key", 1, 8), 16, 10).cast("long"), F.col("blocks")).cast("int"))

    # Blocks in permuted order; the one in which the rest falls is `edge`.
    blocks = placed.groupBy("source", "block", "rest", "whole").agg(F.sum("size").alias("words"))
    order = W.partitionBy("source").orderBy(_keyed(seed + 1, F.col("source"), F.col("block")), "block")
    blocks = blocks.withColumn("upto", F.sum("words").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("place", F.row_number().over(order) - 1)
    blocks = blocks.withColumn("before", F.col("upto") - F.col("words"))
    blocks = blocks.withColumn("part", F.when(F.col("upto") <= F.col("rest"), F.lit(2)).when(F.col("before") < F.col("rest"), F.lit(1)).otherwise(F.lit(0)))
    blocks = materialize(blocks.select("source", "block", "place", "before", "part", "whole", "rest"), "blocks")

    # Documents of the edge blocks, at most one block a source: those that fit in turn, then the one closest to what is left.
    edge = blocks.filter("part = 1").select(F.col("source").alias("s"), F.col("block").alias("b"), "before", F.col("rest").alias("goal"))
    inside = placed.join(edge, placed["source"].eqNullSafe(edge["s"]) & (placed["block"] == edge["b"])).select("source", "doc_id", "size", "order_key", "before", "goal")
    turn = W.partitionBy("source").orderBy("order_key", "doc_id", "size")
    inside = inside.withColumn("turn", F.row_number().over(turn)).withColumn("upto", F.col("before") + F.sum("size").over(turn.rowsBetween(W.unboundedPreceding, 0)))
    inside = inside.withColumn("taken", F.col("upto") <= F.col("goal"))
    gap = F.col("goal") - F.coalesce(F.max(F.when(F.col("taken"), F.col("upto"))).over(W.partitionBy("source")), F.col("before"))
    inside = inside.withColumn("miss", F.when(~F.col("taken"), F.abs(gap - F.col("size"))).otherwise(None)).withColumn("gap", gap)
    best = F.row_number().over(W.partitionBy("source").orderBy(F.col("miss").asc_nulls_last(), "turn")) == 1
    inside = inside.withColumn("extra", best & F.col("miss").isNotNull() & (F.col("miss") < F.col("gap")))
    # Those that fit are the first by their key, so a source's draw is a key up to which all are drawn, how many rows
    # have that key and are drawn, and the same of the extra one.
    key = F.struct("order_key", "doc_id", "size")
    inside = inside.withColumn("cut", F.max(F.when(F.col("taken"), key)).over(W.partitionBy("source"))).withColumn("best", F.max(F.when(F.col("extra"), key)).over(W.partitionBy("source")))
    drawn = inside.filter("taken or extra").groupBy("source").agg(F.first("cut").alias("cut"), F.count_if(key == F.col("cut")).alias("n_cut"), F.first("best").alias("best"), F.count_if(key == F.col("best")).alias("n_best"))
    drawn = materialize(drawn.select(F.col("source").alias("ds"), "cut", "n_cut", "best", "n_best"), "edge")

    # Units dealt to shards: one for each time that a block is drawn.
    times = (F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)).cast("int")
    counted = {r["source"]: r["n"] for r in blocks.groupBy("source").agg(F.sum(times).alias("n")).collect()}
    quotas = split(np.array([counted.get(r["source"], 0) for r in found], np.int64), shards, seed) if found else np.zeros((shards, 0), np.int64)
    # Where each shard's run of a source's units ends: at most MOST_QUOTAS numbers, and a source's row in them.
    ends_of_runs = spark.sparkContext.broadcast(np.cumsum(quotas, axis=0).T.copy())
    place_of = spark.createDataFrame([(r["source"], i) for i, r in enumerate(found)], f"s {dict(rows.dtypes)['source']}, i int")
    units = blocks.join(place_of, blocks["source"].eqNullSafe(place_of["s"])).drop("s")
    ends = F.sum(times).over(W.partitionBy("source").orderBy("place").rowsBetween(W.unboundedPreceding, 0))

    @F.arrow_udf("array<int>")
    def in_shards(source: pa.Array, first: pa.Array, count: pa.Array) -> pa.Array:
        """The shard whose run holds each of the block's units; none beyond the last run, as it is when all quotas are dealt."""
        source, first, count = (c.to_numpy(zero_copy_only=False) for c in (source, first, count))
        runs = ends_of_runs.value
        shards_of = [np.searchsorted(runs[i], np.arange(at, at + n), "right") for i, at, n in zip(source, first, count, strict=True)]
        return pa.array([s[s < runs.shape[1]] for s in shards_of], pa.list_(pa.int32()))

    units = units.withColumn("block_shards", in_shards(F.col("i"), ends - times, times)).drop("i")
    units = units.select(F.col("source").alias("us"), F.col("block").alias("ub"), "part", "block_shards")

    units = units.join(drawn, units["us"].eqNullSafe(drawn["ds"]) & (F.col("part") == 1), "left").drop("ds")
    # Joined on plain columns, so that the window below finds its rows together already; the documents are dealt once.
    units = units.select(F.col("us").isNull().alias("un"), F.coalesce("us", F.lit("")).alias("uk"), "ub", "part", "block_shards", "cut", "n_cut", "best", "n_best")
    placed = placed.withColumn("none", F.col("source").isNull()).withColumn("named", F.coalesce("source", F.lit("")))
    out = placed.join(units, (placed["none"] == units["un"]) & (placed["named"] == units["uk"]) & (placed["block"] == units["ub"])).drop("un", "uk", "ub")
    # Equal rows are told apart by their number, so that as many are drawn as fit; where some may be left out, by their other columns first.
    other = F.when(F.col("part") == 1, F.md5(F.to_json("payload"))) if payload else F.lit(1)
    twin = F.row_number().over(W.partitionBy("none", "named", "block", "order_key", "doc_id", "size").orderBy(other))
    out = out.withColumn("twin", twin)
    fits = (key < F.col("cut")) | ((key == F.col("cut")) & (F.col("twin") <= F.col("n_cut"))) | ((key == F.col("best")) & (F.col("twin") <= F.col("n_best")))
    # In the block in which the rest falls, what doesn't fit is left out of the last draw.
    out = out.withColumn("left_out", F.when((F.col("part") == 1) & ~F.coalesce(fits, F.lit(False)), 1).otherwise(0))
    out = out.withColumn("shards", F.slice("block_shards", F.lit(1), F.greatest(F.size("block_shards") - F.col("left_out"), F.lit(0))))
    drop = ("twin", "none", "named", "cut", "n_cut", "best", "n_best", "part", "left_out", "block_shards", "whole", "rest", "blocks")
    return out.withColumn("copies", F.size("shards")).drop(*drop)


def emit(planned: DataFrame, seed: int = 7) -> DataFrame:
    """One row per drawn copy, by shard and shuffled within it: shard, copy, position_key, and the plan's columns but `shards`.

    Documents that the mix doesn't take give no rows; null and empty texts and repeated rows are
    written as often as they were drawn. Other columns are those of the plan, where docs' own are in
    `payload`, so names can't clash. An empty plan gives no rows. A shard's rows are sorted by a keyed
    hash, which spills where they are many; their texts may be of any length.
    """
    each = planned.filter("copies > 0").select("*", F.posexplode("shards").alias("copy", "shard")).drop("shards")
    each = each.withColumn("position_key", _keyed(seed + 2, F.col("order_key"), F.col("copy")))
    return each.repartition("shard").sortWithinPartitions("shard", "position_key")
