"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hippolake.storage import materialize


#: Links that one task takes in at once; as many need no rounds.
TASK_LINKS = 1_000_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a partition's links: stars around the smallest node of what they connect."""
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    a, b = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1))
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(flat[: len(a)].tolist(), flat[len(a) :].tolist(), strict=True):
        i, j = root(i), root(j)
        if i != j:
            parent[max(i, j)] = min(i, j)
    roots = np.array([root(i) for i in range(len(nodes))], np.int64)
    moved = np.flatnonzero(roots != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[roots[moved]])], ["a", "b"])


def _labels(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def components(links: DataFrame, most_rounds: int = 60, task_links: int = TASK_LINKS) -> DataFrame:
    """links (a, b: long) -> (node, label): for each node with a link the smallest node it is connected to.

    Parts of at most about `task_links` links are contracted in a task each. If there is more than one
    part, rounds of large and small stars settle what the parts have in common; each round is written
    down, so a lost executor costs no more than a round. Links of a node to itself and repeated ones
    don't matter; null ends take no part.
    """
    links = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    parts = 1 + links.count() // task_links
    links = materialize(links.repartition(parts).mapInArrow(_contract, "a long, b long").distinct(), "stars")
    if parts == 1:
        return _labels(links)
    before = None
    for _ in range(most_rounds):
        # Large star: each node gives its smallest neighbour, or itself, to its larger neighbours.
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        # Small star: each node gives its smallest neighbour to its other smaller ones.
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("least").alias("b")), F.struct("a", F.col("least").alias("b")))).alias("e")).select("e.a", "e.b")
        links = materialize(small.filter("a <> b").distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return _labels(links)
        before = now
    raise RuntimeError("the links did not settle")
