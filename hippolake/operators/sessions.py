"""Sessions, chunks and turns of conversations and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gap_sessions(df: DataFrame, key: str, at: Column, gap: float, *, tie: str, at_least: bool = False, name: str = "session") -> DataFrame:
    """Numbers sessions from 0 per key: a new one opens after a gap of more than `gap` seconds (or of at least it)."""
    order = W.partitionBy(key).orderBy("at_", tie)
    rows = df.withColumn("at_", at)
    since = F.col("at_") - F.lag("at_").over(order)
    opens = (since >= gap) if at_least else (since > gap)
    flagged = rows.withColumn("opens", F.coalesce(opens, F.lit(False)).cast("int"))
    return flagged.withColumn(name, F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("opens", "at_")


def pair_turns(turns: DataFrame, *, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """A user turn with the assistant turn that follows it at once."""
    per = W.partitionBy(key).orderBy(order)
    rows = turns.withColumn("next_role", F.lead("role").over(per)).withColumn("reply", F.lead("text").over(per))
    return rows.filter("role = 'user' and next_role = 'assistant'").select(key, order, F.col("text").alias("prompt"), "reply")


def chunks(turns: DataFrame, size: int, *, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Adds chunk (from 0), place within it and the number of chunks."""
    rows = turns.withColumn("n_", F.row_number().over(W.partitionBy(key).orderBy(order)) - 1)
    rows = rows.withColumn("chunk", F.floor(F.col("n_") / size).cast("long")).withColumn("place", (F.col("n_") % size).cast("long"))
    return rows.withColumn("parts", F.max("chunk").over(W.partitionBy(key)) + 1).drop("n_")


def within_budget(turns: DataFrame, most: int, *, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """The first turns whose lengths add up to no more than most; sums only grow, so it stops at the first that is too much."""
    per = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return turns.withColumn("used", F.sum(F.length(text)).over(per)).filter(F.col("used") <= most)


def summaries(turns: DataFrame, cut: int = 300, *, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Per conversation its first user message and last message, cut, and the number of messages."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col(order)))
    return turns.groupBy(key).agg(F.substring(first, 1, cut).alias("first_user"), F.substring(F.max_by("text", order), 1, cut).alias("last"), F.count("*").alias("messages"))


def semantic_sessions(turns: DataFrame, *, gap: float = 1800.0, least: float = 0.55, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Sessions by time and meaning over (key, order, at, embedding): key, order, session.

    A turn opens a session if it comes more than `gap` seconds after the one before (an unknown time
    is no gap) or is less alike the session's normed centroid than `least`. The centroid depends on
    every turn before, so a conversation is folded as one group; it fits in a task as its text does.
    """
    import numpy as np
    import pandas as pd

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        at, vectors = group["at"].to_numpy(np.float64), np.stack([np.asarray(v, np.float64) for v in group["embedding"]])
        session = np.zeros(len(group), np.int64)
        centre = vectors[0].copy()
        for i in range(1, len(group)):
            norm = float(np.sqrt(centre @ centre))
            alike = float(vectors[i] @ (centre / norm if norm >= 1e-9 else centre))
            late = at[i] - at[i - 1]
            opens = (not np.isnan(late) and late > gap) or alike < least
            session[i] = session[i - 1] + opens
            centre = vectors[i].copy() if opens else centre + vectors[i]
        return pd.DataFrame({key: group[key], order: group[order], "session": session})

    kinds = dict(turns.dtypes)
    return turns.groupBy(key).applyInPandas(fold, f"{key} {kinds[key]}, {order} {kinds[order]}, session long")


def assigned_chunks(turns: DataFrame, size: int, *, explicit: Column, gap: float = 1800.0, least: float = 0.55, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, chunk, session, first_turn, last_turn, turns, owner: the slices into which sessions by time and meaning cut chunks of `size` turns.

    turns: key, order, at, embedding. Where `explicit` holds the conversation is a session by itself (0), as its source says; only
    the others are looked through for sessions. A chunk that straddles sessions gives a slice a session; `owner` says which
    one the chunk as a whole counts to: that of its first turn.
    """
    marked = turns.withColumn("explicit", F.coalesce(explicit, F.lit(False)))
    stated = marked.filter("explicit").select(key, order, F.lit(0).cast("long").alias("session"))
    found = semantic_sessions(marked.filter(~F.col("explicit")).select(key, order, "at", "embedding"), gap=gap, least=least, key=key, order=order)
    place = F.row_number().over(W.partitionBy(key).orderBy(order)) - 1
    rows = stated.unionByName(found).withColumn("chunk", F.floor(place / size).cast("long"))
    slices = rows.groupBy(key, "chunk", "session").agg(F.min(order).alias("first_turn"), F.max(order).alias("last_turn"), F.count("*").alias("turns"))
    return slices.withColumn("owner", F.min("session").over(W.partitionBy(key, "chunk")))


def timeline(facts: DataFrame, *, key: Column, at: str, importance: str, crystal: str, entity: str) -> DataFrame:
    """Facts by session or day: when it ended, how important it was (a crystal's, else the greatest, else 8), its entities."""
    own = F.max(F.when(F.col(crystal), F.col(importance)))
    return facts.groupBy(key.alias("bucket")).agg(F.max(at).alias("ended"), F.coalesce(own, F.max(importance), F.lit(8)).alias("importance"), F.count_distinct(entity).alias("entities"), F.count("*").alias("facts"))
