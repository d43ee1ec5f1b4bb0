"""Queries: smaller operators beside the main families."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hippolake.operators import knowledge as K
from hippolake.plans.catalog import query
from hippolake.plans.knowledge import PAIRS_SQL


@query("J14_metadata_rejoin", "SELECT e.vec_id AS id, d.lang, d.source FROM {embeddings} e LEFT JOIN {documents} d ON d.doc_id = e.vec_id")
def metadata_rejoin(role):
    meta = role("documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return role("embeddings").select(F.col("vec_id").alias("id")).join(meta, "id", "left")


@query("J15_candidate_limited_duplicate", PAIRS_SQL + ", capped AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY a DESC) AS place FROM pairs) SELECT b, a, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY cosine DESC, a) AS k FROM capped WHERE place <= 50 AND cosine >= 0.1) WHERE k = 1")
def candidate_limited_duplicate(role):
    """The best match among the 50 newest candidates, the cap being the feature."""
    return K.best_match(K.newest_before(role("claims"), "entity", 50), 0.1).select("b", "a", F.round("cosine", 6).alias("cosine"))


@query("J16_posting_reattach", "SELECT l_orderkey AS id, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS hashes FROM {lineitem} WHERE l_orderkey IN (SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'P') GROUP BY 1")
def posting_reattach(role):
    wanted = role("orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = role("lineitem").join(wanted, "l_orderkey", "left_semi").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("h"))
    return rows.select("id", F.array_join(F.transform("h", lambda h: h["l_partkey"].cast("string")), ",").alias("hashes"))


@query("C12_contradiction_representatives", PAIRS_SQL + " SELECT b AS claim, count(*) AS contradictions, min(a) AS first_existing FROM pairs WHERE cosine >= 0.30 AND cosine < 0.85 GROUP BY 1")
def contradiction_representatives(role):
    return K.band(K.block_pairs(role("claims"), "entity", 0.30), 0.30, 0.85).groupBy(F.col("b").alias("claim")).agg(F.count("*").alias("contradictions"), F.min("a").alias("first_existing"))


@query("C18_tuning_watermark", "SELECT user_id, count(*) FILTER (ts > TIMESTAMP '2024-01-15') AS entries, greatest(max(ts), TIMESTAMP '2024-01-15') AS watermark, epoch(TIMESTAMP '2024-01-31') - epoch(max(ts)) >= 3600 AS runs FROM {events} GROUP BY 1")
def tuning_watermark(role):
    """What a tuning run takes in: entries after the last one, at most once an hour."""
    ts, last = F.col("ts").cast("timestamp"), F.lit("2024-01-15").cast("timestamp")
    rows = role("events").groupBy("user_id").agg(F.count_if(ts > last).alias("entries"), F.greatest(F.max(ts), last).alias("watermark"), (F.unix_timestamp(F.lit("2024-01-31").cast("timestamp")) - F.max(ts).cast("double") >= 3600).alias("runs"))
    return rows.withColumn("watermark", F.col("watermark").cast("timestamp_ntz"))


@query("C19_template_digest", """
WITH r AS (SELECT owner, id, text, row_number() OVER (PARTITION BY owner ORDER BY round(importance * (1 / (1 + (1800000000 - created_at) / 86400.0 / 30)), 12) DESC, id) AS k, count(*) OVER (PARTITION BY owner) AS n FROM {facts})
SELECT owner, 'Facts: ' || max(n) || chr(10) || string_agg(k || '. ' || text, chr(10) ORDER BY k) AS digest FROM r WHERE k <= 10 GROUP BY owner""")
def template_digest(role):
    score = F.round(F.col("importance") * (1 / (1 + (F.lit(1_800_000_000) - F.col("created_at")) / 86400.0 / 30)), 12)
    per = W.partitionBy("owner")
    rows = role("facts").withColumn("k", F.row_number().over(per.orderBy(F.desc(score), "id"))).withColumn("n", F.count("*").over(per)).filter("k <= 10")
    line = F.concat(F.col("k").cast("string"), F.lit(". "), "text")
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", line.alias("line")))), lambda r: r["line"]), "\n")
    return rows.groupBy("owner").agg(F.concat(F.lit("Facts: "), F.max("n").cast("string"), F.lit("\n"), lines).alias("digest"))


@query("C32_rescore_merge", "SELECT conv_id, turn, CASE WHEN n < 5 THEN base ELSE least(greatest(base + turn % 3 - 1, 5), 10) END AS importance FROM (SELECT conv_id, turn, length(text) % 10 + 1 AS base, count(*) OVER (PARTITION BY conv_id) AS n FROM {conversations})")
def rescore_merge(role):
    """Scores of a second look, clamped to 5..10; fewer than five facts are left alone."""
    base = (F.length("text") % 10 + 1).cast("long")
    n = F.count("*").over(W.partitionBy("conv_id"))
    return role("conversations").select("conv_id", "turn", F.when(n < 5, base).otherwise(F.least(F.greatest(base + F.col("turn") % 3 - 1, F.lit(5)), F.lit(10))).alias("importance"))


@query("H18_scope_and_volatility", "SELECT id, round(decay_score * CASE WHEN lang = 'en' THEN 1.0 ELSE 0.5 END * pow(0.5, (1800000000 - created_at) / 86400.0 / CASE source WHEN 'user' THEN 365 ELSE 90 END), 9) AS score FROM {facts}")
def scope_and_volatility(role):
    half = F.when(F.col("source") == "user", 365).otherwise(90)
    days = (F.lit(1_800_000_000) - F.col("created_at")) / 86400.0
    return role("facts").select("id", F.round(F.col("decay_score") * F.when(F.col("lang") == "en", 1.0).otherwise(0.5) * F.pow(F.lit(0.5), days / half), 9).alias("score"))


@query("K5_has_more", "SELECT o_custkey, count(*) > 5 AS has_more, least(count(*), 5) AS page FROM {orders} GROUP BY 1")
def has_more(role):
    return role("orders").groupBy("o_custkey").agg((F.count("*") > 5).alias("has_more"), F.least(F.count("*"), F.lit(5)).alias("page"))


@query("W7_audit_append", "SELECT event_id, user_id, event_type AS action, props AS payload FROM {events}")
def audit_append(role):
    return role("events").select("event_id", "user_id", F.col("event_type").alias("action"), F.col("props").alias("payload"))
