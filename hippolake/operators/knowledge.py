"""Near-duplicates, clusters, contradictions and their resolution, over claims with embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hippolake.functions import scores
from hippolake.functions.text import entity_id
from hippolake.functions.vectors import cosine, cosine_pairs
from hippolake.storage import materialize

TIE = 0.01
STEP, LEAST_WEIGHT, MOST_WEIGHT, LEAST_SUM, MOST_SUM = 0.02, 0.05, 0.60, 0.9, 1.1
PARTS = ("confidence", "corroboration", "recency", "validation")


def block_pairs(claims: DataFrame, block: str, least: float, *, id_col: str = "id") -> DataFrame:
    """a, b, block, cosine of the pairs (a < b) of one block with at least this cosine; a block's rows meet part by part."""
    return cosine_pairs(claims, least, id_col=id_col, vector_col="embedding", block=block)


def newest_before(claims: DataFrame, block: str, most: int, *, id_col: str = "id") -> DataFrame:
    """a, b, block, cosine of each b with the `most` claims of its block that came last before it. A frame of so many rows moves along each block."""
    before = W.partitionBy(block).orderBy(id_col).rowsBetween(-most, -1)
    held = claims.select(F.col(id_col).alias("b"), block, F.col("embedding").alias("eb"), F.collect_list(F.struct(F.col(id_col).alias("a"), F.col("embedding").alias("ea"))).over(before).alias("others"))
    return held.select("b", block, "eb", F.explode("others").alias("e")).select("e.a", "b", block, cosine(F.col("e.ea"), F.col("eb")).alias("cosine"))


def best_match(pairs: DataFrame, least: float) -> DataFrame:
    """For each b the most similar earlier a with cosine >= least; the first among equals."""
    best = F.row_number().over(W.partitionBy("b").orderBy(F.desc(F.round("cosine", 12)), "a"))
    return pairs.filter(F.round("cosine", 12) >= least).withColumn("k", best).filter("k = 1").drop("k")


def band(pairs: DataFrame, low: float, high: float) -> DataFrame:
    """Pairs similar enough to be about one thing and not so similar as to say the same: low <= cosine < high."""
    rounded = F.round("cosine", 12)
    return pairs.filter((rounded >= low) & (rounded < high))


def shared_entities(claims: DataFrame, low: float, high: float, *, id_col: str = "id", entities_col: str = "entities") -> DataFrame:
    """a, b, entity_id, n_shared, cosine: pairs (a < b) that share an entity and whose cosine is in low..high, each once.

    entities: names of each claim, in its own order; names with one normal form are one entity. entity_id is the first of b's, the newer claim's, that a
    has too. A claim stands once under each of its entities, pairs meet entity by entity, part by part, and what
    several entities find is put together. Claims without entities, or without a vector, are in no pair.
    """
    named = claims.select(F.col(id_col).alias("id"), "embedding", F.posexplode(entities_col).alias("place", "name")).withColumn("entity_id", entity_id(F.col("name")))
    listed = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("place", "entity_id"))), lambda x: x["entity_id"]))
    once = named.filter("name IS NOT NULL").groupBy("id").agg(listed.alias("entities"), F.first("embedding").alias("embedding"))
    stands = materialize(once.select("id", "embedding", "entities", F.explode("entities").alias("entity_id")), "entities")
    met = cosine_pairs(stands, low, id_col="id", vector_col="embedding", block="entity_id", blocks="entities")
    return band(met, low, high).select("a", "b", "entity_id", "n_shared", "cosine")


def first_come(nodes: DataFrame, edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(id, leader): going through nodes by id, one without a leader before it that it has an edge to is a leader itself (leader = id); others have the first such.

    nodes: (id), edges: (a, b) with a < b. What a node is depends on those before it that it has an edge
    to, and on nothing else, so all whose answer is known are settled at once, round by round, in joins;
    no group is folded in one task. Rounds are as many as the longest chain of answers that wait for
    each other, few where ids and vectors have little to do with each other.
    """
    edges = materialize(edges.select("a", "b").distinct(), "edges")
    linked = edges.select(F.col("b").alias("id")).distinct()
    # Nodes with no edge to one before them are leaders.
    leaders = materialize(nodes.select("id").join(linked, "id", "left_anti"), "leaders")
    members = None
    waiting = edges
    for _ in range(most_rounds):
        met = waiting.join(leaders.select(F.col("id").alias("a"), F.lit(True).alias("leads")), "a", "left")
        now = materialize(met.filter("leads").groupBy(F.col("b").alias("id")).agg(F.lit(True).alias("member")), "members")
        members = now.select("id") if members is None else members.unionByName(now.select("id"))
        # Edges of new members settle nothing more, to whichever side.
        waiting = waiting.join(now.select(F.col("id").alias("b")), "b", "left_anti").join(now.select(F.col("id").alias("a")), "a", "left_anti")
        settled = waiting.join(leaders.select(F.col("id").alias("a")), "a", "left_anti")
        waiting = materialize(settled, "waiting")
        open_ = linked.join(members, "id", "left_anti").join(leaders, "id", "left_anti")
        fresh = materialize(open_.join(waiting.select(F.col("b").alias("id")).distinct(), "id", "left_anti"), "fresh")
        leaders = materialize(leaders.unionByName(fresh), "leaders")
        if fresh.isEmpty():
            break
    else:
        raise RuntimeError("the nodes did not settle")
    first = edges.join(leaders.select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader"))
    return nodes.select("id").join(leaders.withColumn("leads", F.lit(True)), "id", "left").join(first, "id", "left").select("id", F.when(F.col("leads"), F.col("id")).otherwise(F.col("leader")).alias("leader"))


def greedy_clusters(claims: DataFrame, least: float, *, block: str, singletons: bool = True) -> DataFrame:
    """(block, id, cluster): each claim joins the first cluster of its block whose first member it is similar to, else opens one; by id, clusters numbered from 0.

    Claims without vector are similar to nothing.
    """
    found = claims.select("id", block).join(first_come(claims, block_pairs(claims, block, least)), "id")
    numbers = found.filter("leader = id").select(block, "leader", (F.row_number().over(W.partitionBy(block).orderBy("leader")) - 1).cast("long").alias("cluster"))
    out = found.join(numbers.drop(block), "leader").select(block, "id", "leader", "cluster")
    if not singletons:
        out = out.join(out.groupBy("leader").count().filter("count > 1").select("leader"), "leader", "left_semi")
    return out.select(block, "id", "cluster")


def in_batch_dedup(facts: DataFrame, least: float, *, batch: str) -> DataFrame:
    """(batch, id, kept): dropped if similar to one kept before in its batch, by id; other actions than ADD and facts without vector stay."""
    added = facts.filter((F.col("action") == "ADD") & (F.size("embedding") > 0))
    judged = first_come(added, block_pairs(added, batch, least))
    return facts.select(batch, "id").join(judged, "id", "left").select(batch, "id", F.coalesce(F.col("leader") == F.col("id"), F.lit(True)).alias("kept"))


def representative(claims: DataFrame, group: str, *, decay: str, created: str, text: str, order: str = "id") -> DataFrame:
    """The claim that stands for its group: greatest decay, then newest, then longest in bytes, then first."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc(decay), F.desc(created), F.desc(F.octet_length(text)), order))
    return claims.withColumn("k", rank).filter("k = 1").drop("k")


def with_scores(claims: DataFrame, weights: dict[str, float] = scores.DEFAULT_WEIGHTS) -> DataFrame:
    parts = scores.components(F.col("confidence"), F.col("corroboration"), F.col("age_days"), F.col("validation"), weights)
    return claims.select("id", "pinned", F.struct(*[v.alias(k) for k, v in parts.items()]).alias("parts"))


def resolve(pairs: DataFrame, scored: DataFrame) -> DataFrame:
    """pairs (a: existing, b: new) with action and reason: pinned claims stay, near ties are left, else the higher score wins; a tie goes to the new one."""
    old = scored.select(F.col("id").alias("a"), F.col("pinned").alias("old_pinned"), F.col("parts").alias("old"))
    new = scored.select(F.col("id").alias("b"), F.col("parts").alias("new"))
    met = pairs.join(old, "a").join(new, "b")
    margin = F.round(F.col("new.weighted_total") - F.col("old.weighted_total"), 12)
    action = F.when(F.col("old_pinned"), "skip_new").when(margin < 0, "skip_new").when(margin < TIE, "tie_leave_both").otherwise("supersede_existing")
    reason = F.when(F.col("old_pinned"), "existing_pinned").when(margin < 0, "existing_wins")
    return met.withColumn("margin", margin).withColumn("action", action).withColumn("reason", reason)


def shadow(decisions: DataFrame, mode: str) -> DataFrame:
    """Decision rows in `active` mode lose their ties; in `shadow` mode all but ties are renamed; `off` logs nothing."""
    if mode == "off":
        return decisions.limit(0)
    if mode == "active":
        return decisions.filter("action <> 'tie_leave_both'")
    return decisions.withColumn("action", F.when(F.col("action") == "tie_leave_both", F.col("action")).otherwise(F.lit("shadow")))


def tune(log: DataFrame, *, key: str, order: str, start: dict[str, float] = scores.DEFAULT_WEIGHTS) -> DataFrame:
    """Weights per key after a log of (winner, loser) parts in order: each step moves a weight by STEP times the clamped difference.

    The fold runs inside one aggregate over a key's ordered log; a key's log is one user's feedback.
    """
    listed = log.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "winner", "loser"))).alias("log"))
    clamp = scores.clamp

    def step(acc: Column, row: Column) -> Column:
        moved = {p: clamp(acc[p] + STEP * clamp(row["loser"][p] - row["winner"][p], -1.0, 1.0), LEAST_WEIGHT, MOST_WEIGHT) for p in PARTS}
        total = sum(moved.values(), F.lit(0.0))
        off = (total < LEAST_SUM) | (total > MOST_SUM)
        return F.struct(*[F.when(off, clamp(moved[p] / total, LEAST_WEIGHT, MOST_WEIGHT)).otherwise(moved[p]).alias(p) for p in PARTS], (acc["n"] + 1).alias("n"))

    first = F.struct(*[F.lit(start[p]).alias(p) for p in PARTS], F.lit(0).alias("n"))
    return listed.select(key, F.aggregate("log", first, step).alias("w")).select(key, *[F.col(f"w.{p}").alias(p) for p in PARTS], F.col("w.n").alias("feedback_count"))


def is_counterexample(winner: Column, decision: Column) -> Column:
    """What a user's decision says about the formula's: 'loser' if they pinned the other one, 'both', or null."""
    return F.when(decision == "pin_both", "both").when(((winner == "a") & (decision == "pin_b")) | ((winner == "b") & (decision == "pin_a")), "loser")
