"""Co-occurrence graphs, chains and breakdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hippolake.storage import materialize


def nodes(mentions: DataFrame, most: int, *, session: str, entity: str) -> DataFrame:
    """Entities by the number of sessions they occur in, the first `most` of them, ties by name."""
    counted = mentions.select(session, entity).distinct().groupBy(entity).agg(F.count("*").alias("weight"))
    return counted.orderBy(F.desc("weight"), entity).limit(most)


def co_occurrence(mentions: DataFrame, kept: DataFrame, *, session: str, entity: str) -> DataFrame:
    """Links (a < b) of kept entities that share a session, by how many they share."""
    seen = mentions.select(session, entity).distinct().join(kept.select(entity), entity, "left_semi")
    left, right = seen.withColumnRenamed(entity, "a"), seen.withColumnRenamed(entity, "b")
    return left.join(right, session).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def dominant(rows: DataFrame, key: str, vote: str, order: str) -> DataFrame:
    """Per key the value with most votes; of those with as many the one seen first."""
    votes = rows.groupBy(key, vote).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return votes.groupBy(key).agg(F.max_by(vote, F.struct(F.col("n"), -F.col("first"))).alias("dominant"))


def chains(links: DataFrame, *, most_steps: int = 40) -> DataFrame:
    """links (id, next) of supersession: (id, root, depth) by following `next` backwards to a root.

    Pointers double at each step, so a chain of 2**n claims takes n steps; each step is written down.
    A claim in a cycle has no root and is left out. A claim superseded by several is followed from the smallest.
    """
    before = links.groupBy(F.col("next").alias("id")).agg(F.min("id").alias("up"))
    state = links.select(F.explode(F.array("id", "next")).alias("id")).distinct().join(before, "id", "left").select("id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.coalesce("up", "id").alias("root"))
    state = materialize(state, "chains")
    for _ in range(most_steps):
        if not state.filter("up is not null").limit(1).count():
            return state.select("id", "root", "depth")
        jump = state.select(F.col("id").alias("via"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("root").alias("root2"))
        moved = state.join(jump, state["up"] == jump["via"], "left")
        following = moved.select("id", "up2", (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.coalesce("root2", "root").alias("root")).withColumnRenamed("up2", "up")
        state = materialize(following, "chains")
    return state.filter("up is null").select("id", "root", "depth")
