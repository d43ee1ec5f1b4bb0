"""Queries: sessions, chunks, turns."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hippolake.operators import sessions as S
from hippolake.plans.catalog import query

def _epoch():
    return F.col("ts").cast("timestamp").cast("double")



@query("R3_gap_sessions", """
WITH gaps AS (SELECT *, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id) > 43200 AS opens FROM {events})
SELECT event_id, user_id, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM gaps""")
def gap_sessions(role):
    return S.gap_sessions(role("events"), "user_id", _epoch(), 43200, tie="event_id").select("event_id", "user_id", "session")


@query("R4_idle_rollover", """
WITH mins AS (SELECT *, CAST(floor(epoch(ts) / 60) AS BIGINT) AS m FROM {events}), gaps AS (SELECT *, m - lag(m) OVER (PARTITION BY user_id ORDER BY m, event_id) >= 720 AS opens FROM mins)
SELECT event_id, user_id, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY m, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM gaps""")
def idle_rollover(role):
    return S.gap_sessions(role("events"), "user_id", F.floor(_epoch() / 60), 720, tie="event_id", at_least=True).select("event_id", "user_id", "session")


@query("R5_turn_pairs", "SELECT conv_id, turn, text AS prompt, reply FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS reply FROM {conversations} WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant'")
def turn_pairs(role):
    return S.pair_turns(role("conversations"))


@query("R6_fixed_chunks", "SELECT conv_id, turn, n // 3 AS chunk, n % 3 AS place, (max(n) OVER (PARTITION BY conv_id)) // 3 + 1 AS parts FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM {conversations})")
def fixed_chunks(role):
    return S.chunks(role("conversations"), 3).select("conv_id", "turn", "chunk", "place", "parts")


@query("R7_turn_slices", """
WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM {conversations})
SELECT conv_id, n // 3 AS chunk, min(n % 3) AS msg_start, least(max(n % 3) + 1, 3) AS msg_end, max(total) AS total FROM n GROUP BY 1, 2""")
def turn_slices(role):
    rows = S.chunks(role("conversations"), 3).withColumn("total", F.count("*").over(W.partitionBy("conv_id")))
    return rows.groupBy("conv_id", "chunk").agg(F.min("place").alias("msg_start"), F.least(F.max("place") + 1, F.lit(3)).cast("long").alias("msg_end"), F.max("total").alias("total"))


@query("R8_conversation_summary", "SELECT conv_id, substr(min_by(text, turn) FILTER (role = 'user'), 1, 300) AS first_user, substr(max_by(text, turn), 1, 300) AS last, count(*) AS messages FROM {conversations} GROUP BY 1")
def conversation_summary(role):
    return S.summaries(role("conversations"))


@query("R12_numbered_lines", "SELECT conv_id, string_agg(n || '. [' || role || '] ' || text, chr(10) ORDER BY n) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM {conversations}) GROUP BY 1")
def numbered_lines(role):
    rows = role("conversations").withColumn("n", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")))
    line = F.concat(F.col("n").cast("string"), F.lit(". ["), "role", F.lit("] "), "text")
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))), lambda r: r["line"]), "\n").alias("prompt"))


@query("K6_message_budget", "SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM {conversations}) WHERE used <= 1200")
def message_budget(role):
    return S.within_budget(role("conversations"), 1200).select("conv_id", "turn", "used")


@query("A9_timeline", """
SELECT CASE WHEN value > 20 THEN 's' || user_id ELSE strftime(ts, '%Y-%m-%d') END AS bucket, max(ts) AS ended, coalesce(max(floor(value)) FILTER (event_type = 'purchase'), max(floor(value)), 8) AS importance, count(DISTINCT event_type) AS entities, count(*) AS facts FROM {events} GROUP BY 1""")
def timeline(role):
    key = F.when(F.col("value") > 20, F.concat(F.lit("s"), F.col("user_id").cast("string"))).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    rows = role("events").withColumn("weight", F.floor("value").cast("double")).withColumn("crystal", F.col("event_type") == "purchase")
    return S.timeline(rows, key=key, at="ts", importance="weight", crystal="crystal", entity="event_type")


#: Going through `rows` (grp, k from 1, item, secs_at, v) of each group: the session of each, and its vectors' sum so far.
WALK_SQL = """WITH RECURSIVE rows AS ({rows}), walk AS (
  SELECT grp, k, item, secs_at, CAST(0 AS BIGINT) AS session, v AS centre FROM rows WHERE k = 1
  UNION ALL SELECT grp, k, item, secs_at, session + CASE WHEN opens THEN 1 ELSE 0 END, CASE WHEN opens THEN v ELSE list_transform(list_zip(centre, v), lambda z: z[1] + z[2]) END
  FROM (SELECT r.grp, r.k, r.item, r.secs_at, r.v, w.session, w.centre, coalesce(r.secs_at - w.secs_at > {gap}, false) OR list_dot_product(r.v, w.centre) / CASE WHEN list_dot_product(w.centre, w.centre) >= 1e-18 THEN sqrt(list_dot_product(w.centre, w.centre)) ELSE 1 END < 0.55 AS opens
    FROM walk w JOIN rows r ON r.grp = w.grp AND r.k = w.k + 1))
"""
_TURN_ROWS = "SELECT conv_id AS grp, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, turn AS item, CAST(secs AS DOUBLE) AS secs_at, %s AS v FROM {turns} JOIN {embeddings} ON (conv_id * 7 + turn // 2) %% 500 = vec_id %s"
_SHIFTED = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: x + 0.12)"


def _walk_sql(rows: str, gap: int) -> str:
    return WALK_SQL.replace("{rows}", rows).replace("{gap}", str(gap))


@query("C22_semantic_sessions", _walk_sql(_TURN_ROWS % ("CAST(embedding AS DOUBLE[])", ""), 1800) + "SELECT grp AS conv_id, item AS turn, session FROM walk")
def semantic_sessions(role):
    rows = role("turns").join(role("embeddings").select(F.col("vec_id").alias("v"), "embedding"), F.pmod(F.col("conv_id") * 7 + F.floor(F.col("turn") / 2), F.lit(500)) == F.col("v"))
    return S.semantic_sessions(rows.select("conv_id", "turn", F.col("secs").cast("double").alias("at"), "embedding"))


@query("C23_session_assignment", """
WITH t AS (SELECT *, secs - lag(secs) OVER (PARTITION BY conv_id ORDER BY secs, turn) > 1800 AS opens FROM {turns}),
s AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY secs, turn) AS k FROM t)
SELECT CASE WHEN conv_id % 3 = 0 THEN 'c' || conv_id ELSE 'c' || conv_id || '-' || k END AS session_id, conv_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS turns FROM s GROUP BY 1, 2""")
def session_assignment(role):
    """Conversations that name their session keep it; the others are cut at gaps, and chunks that straddle a cut are split."""
    rows = S.gap_sessions(role("turns"), "conv_id", F.col("secs"), 1800, tie="turn")
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.when(F.col("conv_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("-"), F.col("session").cast("string"))))
    return rows.groupBy(name.alias("session_id"), "conv_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("turns"))


def _alike(vector: str):
    """Vectors moved towards one direction, so that some neighbours are alike and some aren't."""
    return F.transform(vector, lambda x: x.cast("double") + 0.12)


@query("C23_assigned_chunks", _walk_sql(_TURN_ROWS % (_SHIFTED, "WHERE conv_id % 3 <> 0"), 1800) + """, sessions AS (SELECT grp AS conv_id, item AS turn, session FROM walk UNION ALL SELECT conv_id, turn, 0 FROM {turns} JOIN {embeddings} ON (conv_id * 7 + turn // 2) % 500 = vec_id WHERE conv_id % 3 = 0),
placed AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4 AS chunk FROM sessions),
slices AS (SELECT conv_id, chunk, session, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS turns FROM placed GROUP BY 1, 2, 3)
SELECT conv_id, chunk, session, first_turn, last_turn, turns, min(session) OVER (PARTITION BY conv_id, chunk) AS owner FROM slices""")
def assigned_chunks(role):
    """Chunks of four turns, cut where sessions by time and meaning cut them; conversations that name their session keep it."""
    rows = role("turns").join(role("embeddings").select(F.col("vec_id").alias("v"), _alike("embedding").alias("embedding")), F.pmod(F.col("conv_id") * 7 + F.floor(F.col("turn") / 2), F.lit(500)) == F.col("v"))
    return S.assigned_chunks(rows.select("conv_id", "turn", F.col("secs").cast("double").alias("at"), "embedding"), 4, explicit=F.col("conv_id") % 3 == 0)


@query("C24_semantic_plan", _walk_sql(f"SELECT owner AS grp, row_number() OVER (PARTITION BY owner ORDER BY id) AS k, id AS item, CAST(created_at AS DOUBLE) AS secs_at, {_SHIFTED} AS v FROM {{claims}} WHERE NOT pinned", 86400) + """, sized AS (SELECT grp, session, count(*) AS n FROM walk GROUP BY 1, 2)
SELECT grp AS owner, CAST(sum(n) AS BIGINT) AS atomic, count(*) FILTER (n > 1) AS multi_sessions, count(*) FILTER (n = 1) AS singletons, CAST(max(n) AS BIGINT) AS largest FROM sized GROUP BY 1""")
def semantic_plan(role):
    """What crystals are to be made anew of each owner's atomic facts: sessions by time and meaning, in order of time."""
    atomic = role("claims").filter("NOT pinned").select("owner", "id", F.col("created_at").cast("double").alias("at"), _alike("embedding").alias("embedding"))
    sized = S.semantic_sessions(atomic, gap=86_400.0, key="owner", order="id").groupBy("owner", "session").agg(F.count("*").alias("n"))
    return sized.groupBy("owner").agg(F.sum("n").alias("atomic"), F.count_if(F.col("n") > 1).alias("multi_sessions"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("largest"))


@query("C24_recrystallise_plan", """
WITH g AS (SELECT *, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id) > 43200 AS opens FROM {events} WHERE event_type <> 'purchase'),
s AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id ROWS UNBOUNDED PRECEDING) AS k FROM g),
n AS (SELECT user_id, k, count(*) AS facts FROM s GROUP BY 1, 2)
SELECT user_id, CAST(sum(facts) AS BIGINT) AS atomic, count(*) FILTER (facts > 1) AS multi_sessions, count(*) FILTER (facts = 1) AS singletons FROM n GROUP BY 1""")
def recrystallise_plan(role):
    atomic = role("events").filter("event_type <> 'purchase'")
    rows = S.gap_sessions(atomic, "user_id", _epoch(), 43200, tie="event_id").groupBy("user_id", "session").agg(F.count("*").alias("facts"))
    return rows.groupBy("user_id").agg(F.sum("facts").alias("atomic"), F.count_if(F.col("facts") > 1).alias("multi_sessions"), F.count_if(F.col("facts") == 1).alias("singletons"))


@query("ST6_gap_session_window", """
WITH gaps AS (SELECT *, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 43200 AS opens FROM {events}),
s AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM gaps)
SELECT user_id, min(ts) AS began, max(ts) AS ended, count(*) AS events FROM s GROUP BY user_id, k""")
def gap_session_window(role):
    return role("events").groupBy("user_id", F.session_window("ts", "12 hours")).agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("events")).drop("session_window")
