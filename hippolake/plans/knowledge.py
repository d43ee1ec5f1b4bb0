"""Queries: near-duplicates, contradictions, resolution, decay and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hippolake.functions import scores
from hippolake.functions import text as T
from hippolake.operators import knowledge as K
from hippolake.plans.catalog import query

_COS = "list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(y.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[]))))"
PAIRS_SQL = f"WITH pairs AS (SELECT x.id AS a, y.id AS b, x.entity, round({_COS}, 12) AS cosine FROM {{claims}} x JOIN {{claims}} y ON x.entity = y.entity AND x.id < y.id)"
SCORES_SQL = """, parts AS (SELECT id, pinned, greatest(0.0, least(1.0, confidence)) AS confidence, least(sqrt(greatest(corroboration, 1)), 3.0) AS corroboration, 1 / (1 + coalesce(age_days, 10000.0) / 30) AS recency,
  CASE validation WHEN 'explicit' THEN 1.0 WHEN 'inferred' THEN 0.95 ELSE 0.7 END AS validation FROM {claims}),
totals AS (SELECT *, confidence * 0.25 + corroboration * 0.15 + recency * 0.40 + validation * 0.20 AS total FROM parts)"""
RESOLVED_SQL = PAIRS_SQL + SCORES_SQL + """, resolved AS (SELECT p.a, p.b, p.cosine, round(n.total - o.total, 12) AS margin, o.pinned,
  CASE WHEN o.pinned OR round(n.total - o.total, 12) < 0 THEN 'skip_new' WHEN round(n.total - o.total, 12) < 0.01 THEN 'tie_leave_both' ELSE 'supersede_existing' END AS action,
  CASE WHEN o.pinned THEN 'existing_pinned' WHEN round(n.total - o.total, 12) < 0 THEN 'existing_wins' END AS reason
  FROM pairs p JOIN totals o ON o.id = p.a JOIN totals n ON n.id = p.b WHERE p.cosine >= 0.30 AND p.cosine < 0.85)"""


def _pairs(role, least: float) -> DataFrame:
    return K.block_pairs(role("claims"), "entity", least)


def _resolved(role) -> DataFrame:
    return K.resolve(K.band(_pairs(role, 0.30), 0.30, 0.85), K.with_scores(role("claims")))


@query("J5_best_duplicate", PAIRS_SQL + "SELECT b, a, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY cosine DESC, a) AS k FROM pairs WHERE cosine >= 0.2) WHERE k = 1")
def best_duplicate(role):
    return K.best_match(_pairs(role, 0.2), 0.2).select("b", "a", F.round("cosine", 6).alias("cosine"))


@query("J6_contradiction_band", PAIRS_SQL + "SELECT a, b, entity, round(cosine, 6) AS cosine FROM pairs WHERE cosine >= 0.30 AND cosine < 0.85")
def contradiction_band(role):
    return K.band(_pairs(role, 0.30), 0.30, 0.85).select("a", "b", "entity", F.round("cosine", 6).alias("cosine"))


@query("J6_shared_entities", f"""
WITH tagged AS (SELECT d.doc_id AS id, e.embedding, CASE WHEN d.doc_id % 2 = 0 THEN ['label ' || e.label, 'Lang  ' || d.lang, 'LABEL ' || e.label, 'source ' || d.source] ELSE ['source ' || d.source, 'Lang  ' || d.lang, 'LABEL ' || e.label] END AS names FROM {{documents}} d JOIN {{embeddings}} e ON d.doc_id = e.vec_id),
named AS (SELECT id, embedding, list_transform(names, lambda n: substr(sha256(trim(regexp_replace(lower(nfc_normalize(n)), '\\s+', ' ', 'g'))), 1, 16)) AS ids FROM tagged),
pairs AS (SELECT x.id AS a, y.id AS b, list_filter(y.ids, lambda i: list_contains(x.ids, i)) AS shared, round({_COS}, 12) AS cosine FROM named x JOIN named y ON x.id < y.id AND list_has_any(x.ids, y.ids))
SELECT a, b, shared[1] AS entity_id, len(list_distinct(shared)) AS n_shared, round(cosine, 6) AS cosine FROM pairs WHERE cosine >= 0.30 AND cosine < 0.85""")
def shared_entities(role):
    """Claims of several entities that may contradict: each pair once, under the first of the newer claim's entities that both have."""
    names = F.array(F.concat(F.lit("label "), F.col("label")), F.concat(F.lit("Lang  "), F.col("lang")), F.concat(F.lit("LABEL "), F.col("label")), F.concat(F.lit("source "), F.col("source")))
    docs = role("documents").join(role("embeddings"), F.col("doc_id") == F.col("vec_id"))
    odd = F.array(names[3], names[1], names[2])
    claims = docs.select(F.col("doc_id").alias("id"), "embedding", F.when(F.col("doc_id") % 2 == 0, names).otherwise(odd).alias("entities"))
    return K.shared_entities(claims, 0.30, 0.85).select("a", "b", "entity_id", F.col("n_shared").cast("long").alias("n_shared"), F.round("cosine", 6).alias("cosine"))


@query("J7_entity_candidates", "SELECT claim, candidate FROM (SELECT x.id AS claim, y.id AS candidate, row_number() OVER (PARTITION BY x.id, x.entity ORDER BY y.created_at DESC, y.id) AS k FROM {claims} x JOIN {claims} y ON x.entity = y.entity AND x.id <> y.id) WHERE k <= 20")
def entity_candidates(role):
    # One more than wanted, as a claim may be among its entity's newest itself.
    claims = role("claims")
    newest = F.row_number().over(W.partitionBy("entity").orderBy(F.desc("created_at"), "id"))
    held = claims.select(F.col("id").alias("candidate"), "entity", newest.alias("place")).filter("place <= 21")
    met = claims.select(F.col("id").alias("claim"), "entity").join(held, "entity").filter("claim <> candidate")
    nearest = F.row_number().over(W.partitionBy("claim", "entity").orderBy("place"))
    return met.withColumn("k", nearest).filter("k <= 20").select("claim", "candidate").distinct()


#: Going through `rows` (block, id, v: unit vectors) by id: the leaders so far, and the number of the one that each is like.
FIRST_COME_SQL = """WITH RECURSIVE rows AS (SELECT block, id, v, row_number() OVER (PARTITION BY block ORDER BY id) AS k FROM ({rows})),
walk AS (SELECT block, k, id, [v] AS leaders, CAST(0 AS BIGINT) AS cluster, true AS leads FROM rows WHERE k = 1
  UNION ALL SELECT block, k, id, CASE WHEN hit IS NULL THEN list_append(leaders, v) ELSE leaders END, CAST(coalesce(hit - 1, len(leaders)) AS BIGINT), hit IS NULL
  FROM (SELECT x.block, x.k, x.id, x.v, w.leaders, list_position(list_transform(w.leaders, lambda l: round(list_dot_product(l, x.v), 12) >= 0.2), true) AS hit FROM walk w JOIN rows x ON x.block = w.block AND x.k = w.k + 1))
"""
_UNIT = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))))"
CLUSTERS_SQL = FIRST_COME_SQL.replace("{rows}", f"SELECT entity AS block, id, {_UNIT} AS v FROM {{claims}}")


@query("C3_in_batch_dedup", FIRST_COME_SQL.replace("{rows}", f"SELECT owner AS block, id, {_UNIT} AS v FROM {{claims}} WHERE id % 9 <> 0") + "SELECT owner, c.id, coalesce(leads, true) AS kept FROM {claims} c LEFT JOIN walk w ON w.id = c.id")
def in_batch_dedup(role):
    facts = role("claims").select("id", "owner", "embedding", F.when(F.col("id") % 9 == 0, "UPDATE").otherwise("ADD").alias("action"))
    return K.in_batch_dedup(facts, 0.2, batch="owner")


@query("C4_greedy_clusters", CLUSTERS_SQL + "SELECT block AS entity, id, cluster FROM walk")
def greedy_clusters(role):
    return K.greedy_clusters(role("claims").select("id", "entity", "embedding"), 0.2, block="entity")


@query("C5_representatives", "SELECT owner, id FROM (SELECT owner, id, row_number() OVER (PARTITION BY owner ORDER BY decay_score DESC, created_at DESC, strlen(text) DESC, id) AS k FROM {facts}) WHERE k = 1")
def representatives(role):
    return K.representative(role("facts"), "owner", decay="decay_score", created="created_at", text="text").select("owner", "id")


@query("C6_supersede_rule", PAIRS_SQL + "SELECT p.a, p.b, y.importance >= x.importance AS supersedes FROM pairs p JOIN {claims} x ON x.id = p.a JOIN {claims} y ON y.id = p.b WHERE p.cosine >= 0.2")
def supersede_rule(role):
    claims = role("claims").select("id", "importance")
    met = _pairs(role, 0.2)
    old, new = claims.select(F.col("id").alias("a"), F.col("importance").alias("old")), claims.select(F.col("id").alias("b"), F.col("importance").alias("new"))
    return met.join(old, "a").join(new, "b").select("a", "b", (F.col("new") >= F.col("old")).alias("supersedes"))


@query("C7_consolidation_report", CLUSTERS_SQL + "SELECT block AS entity, count(*) FILTER (n > 1) AS clusters, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT block, cluster, count(*) AS n FROM walk GROUP BY 1, 2) GROUP BY 1")
def consolidation_report(role):
    clusters = K.greedy_clusters(role("claims").select("id", "entity", "embedding"), 0.2, block="entity").groupBy("entity", "cluster").agg(F.count("*").alias("n"))
    return clusters.groupBy("entity").agg(F.count_if(F.col("n") > 1).alias("clusters"), F.sum(F.col("n") - 1).alias("duplicates"))


@query("C8_entity_ids", r"SELECT item_id, trim(regexp_replace(lower(nfc_normalize(text)), '\s+', ' ', 'g')) AS name, substr(sha256(trim(regexp_replace(lower(nfc_normalize(text)), '\s+', ' ', 'g'))), 1, 16) AS entity_id FROM {benchmark}")
def entity_ids(role):
    name = F.col("text")
    return role("benchmark").select("item_id", T.normalise(T.nfc(name)).alias("name"), T.entity_id(name).alias("entity_id"))


#: Words of texts, each also with its accents as marks of their own: e with an acute accent and e followed by the mark, say.
_DECOMPOSED = (("é", "e\u0301"), ("è", "e\u0300"), ("ê", "e\u0302"), ("ç", "c\u0327"), ("ü", "u\u0308"), ("ä", "a\u0308"), ("ö", "o\u0308"), ("ó", "o\u0301"), ("ñ", "n\u0303"), ("í", "i\u0301"))


def _apart_sql(text: str) -> str:
    for whole, parts in _DECOMPOSED:
        text = f"replace({text}, '{whole}', '{parts[0]}' || chr({ord(parts[1])}))"
    return text


@query("C8_composed_names", f"""
WITH names AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS name FROM {{documents}}), spelt AS (SELECT name FROM names UNION SELECT {_apart_sql("name")} FROM names),
ids AS (SELECT name, substr(sha256(trim(regexp_replace(lower(nfc_normalize(name)), '\\s+', ' ', 'g'))), 1, 16) AS entity_id FROM spelt)
SELECT entity_id, count(*) AS spellings, min(nfc_normalize(name)) AS first FROM ids GROUP BY entity_id HAVING count(*) > 1""")
def composed_names(role):
    """Entity ids that several spellings of a name share: in case, and with accents composed or apart."""
    names = role("documents").select(F.explode(F.split("text", " ")).alias("name")).distinct()
    apart = F.col("name")
    for whole, parts in _DECOMPOSED:
        apart = F.replace(apart, F.lit(whole), F.lit(parts))
    spelt = names.unionAll(names.select(apart.alias("name"))).distinct()
    return spelt.groupBy(T.entity_id(F.col("name")).alias("entity_id")).agg(F.count("*").alias("spellings"), F.min(T.nfc(F.col("name"))).alias("first")).filter("spellings > 1")


@query("C9_entity_trapdoors", r"SELECT c_custkey, sha256('entity:' || trim(regexp_replace(lower(c_name), '\s+', ' ', 'g'))) AS trapdoor FROM {customer}")
def entity_trapdoors(role):
    return role("customer").select("c_custkey", T.entity_trapdoor(F.col("c_name")).alias("trapdoor"))


@query("C1_fingerprint_groups", r"SELECT min(doc_id) AS first_id, count(*) AS copies FROM {documents} GROUP BY trim(regexp_replace(lower(nfc_normalize(text)), '\s+', ' ', 'g')) HAVING count(*) > 1")
def fingerprint_groups(role):
    return role("documents").groupBy(T.fingerprint(F.col("text"), b"k" * 32).alias("fp")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1").drop("fp")


@query("C10_score_components", "WITH one AS (SELECT 1)" + SCORES_SQL + " SELECT id, round(confidence, 9) AS confidence, round(corroboration, 9) AS corroboration, round(recency, 9) AS recency, round(validation, 9) AS validation, round(total, 9) AS weighted_total FROM totals")
def score_components(role):
    return K.with_scores(role("claims")).select("id", *[F.round(f"parts.{p}", 9).alias(p) for p in (*K.PARTS, "weighted_total")])


@query("C11_pair_resolution", PAIRS_SQL + SCORES_SQL + " SELECT p.a, p.b, CASE WHEN round(x.total, 12) >= round(y.total, 12) THEN p.a ELSE p.b END AS winner FROM pairs p JOIN totals x ON x.id = p.a JOIN totals y ON y.id = p.b WHERE p.cosine >= 0.3")
def pair_resolution(role):
    scored = K.with_scores(role("claims")).select("id", F.round("parts.weighted_total", 12).alias("total"))
    met = _pairs(role, 0.3)
    met = met.join(scored.select(F.col("id").alias("a"), F.col("total").alias("ta")), "a").join(scored.select(F.col("id").alias("b"), F.col("total").alias("tb")), "b")
    return met.select("a", "b", F.when(F.col("ta") >= F.col("tb"), F.col("a")).otherwise(F.col("b")).alias("winner"))


@query("C13_resolve_contradictions", RESOLVED_SQL + " SELECT a, b, action, reason, round(margin, 6) AS margin FROM resolved")
def resolve_contradictions(role):
    return _resolved(role).select("a", "b", "action", "reason", F.round("margin", 6).alias("margin"))


@query("C14_shadow_decisions", RESOLVED_SQL + " SELECT a, b, CASE WHEN action = 'tie_leave_both' THEN action ELSE 'shadow' END AS action FROM resolved")
def shadow_decisions(role):
    return K.shadow(_resolved(role), "shadow").select("a", "b", "action")


@query("F19_active_decisions", RESOLVED_SQL + " SELECT a, b, action FROM resolved WHERE action <> 'tie_leave_both'")
def active_decisions(role):
    return K.shadow(_resolved(role), "active").select("a", "b", "action")


@query("C15_drop_losers", RESOLVED_SQL + " SELECT id FROM {claims} WHERE id NOT IN (SELECT b FROM resolved WHERE action = 'skip_new')")
def drop_losers(role):
    lost = _resolved(role).filter("action = 'skip_new'").select(F.col("b").alias("id")).distinct()
    return role("claims").select("id").join(lost, "id", "left_anti")


_FEEDBACK = ("CASE event_type WHEN 'click' THEN 'pin_a' WHEN 'view' THEN 'pin_b' WHEN 'purchase' THEN 'pin_both' ELSE 'unpin' END AS decision", "CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS winner")


@query("C16_counterexamples", f"SELECT event_id, CASE WHEN decision = 'pin_both' THEN 'both' WHEN (winner = 'a' AND decision = 'pin_b') OR (winner = 'b' AND decision = 'pin_a') THEN 'loser' END AS pinned FROM (SELECT event_id, {', '.join(_FEEDBACK)} FROM {{events}})")
def counterexamples(role):
    rows = role("events").selectExpr("event_id", *_FEEDBACK)
    return rows.select("event_id", K.is_counterexample(F.col("winner"), F.col("decision")).alias("pinned"))


def _feedback_log(role) -> DataFrame:
    e = F.col("event_id")
    winner = F.struct((e % 10 / 10.0).alias("confidence"), (e % 4).cast("double").alias("corroboration"), (e % 7 / 7.0).alias("recency"), (e % 3 / 3.0).alias("validation"))
    loser = F.struct((e % 9 / 9.0).alias("confidence"), (e % 5).cast("double").alias("corroboration"), (e % 8 / 8.0).alias("recency"), (e % 2 / 2.0).alias("validation"))
    return role("events").filter("event_type in ('click', 'view')").select("user_id", "event_id", winner.alias("winner"), loser.alias("loser"))


def _tune_sql(last: str) -> str:
    clamp = lambda x, low, high: f"greatest({low}, least({high}, {x}))"
    moved = {p: clamp(f"w.{p} + 0.02 * {clamp(f'f.l_{p} - f.w_{p}', -1.0, 1.0)}", 0.05, 0.6) for p in K.PARTS}
    starts = ", ".join(f"CAST({scores.DEFAULT_WEIGHTS[p]} AS DOUBLE) AS {p}" for p in K.PARTS)
    total = " + ".join(f"m_{p}" for p in K.PARTS)
    rescaled = ", ".join(f"CASE WHEN {total} < 0.9 OR {total} > 1.1 THEN greatest(0.05, least(0.6, m_{p} / ({total}))) ELSE m_{p} END AS {p}" for p in K.PARTS)
    return f"""
WITH RECURSIVE log AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r,
  event_id % 10 / 10.0::DOUBLE AS w_confidence, (event_id % 4)::DOUBLE AS w_corroboration, event_id % 7 / 7.0::DOUBLE AS w_recency, event_id % 3 / 3.0::DOUBLE AS w_validation,
  event_id % 9 / 9.0::DOUBLE AS l_confidence, (event_id % 5)::DOUBLE AS l_corroboration, event_id % 8 / 8.0::DOUBLE AS l_recency, event_id % 2 / 2.0::DOUBLE AS l_validation
  FROM {{events}} WHERE event_type IN ('click', 'view')),
walk AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS r, {starts} FROM log
  UNION ALL SELECT user_id, r, {rescaled} FROM (SELECT w.user_id, f.r, {", ".join(f"{x} AS m_{p}" for p, x in moved.items())} FROM walk w JOIN log f ON f.user_id = w.user_id AND f.r = w.r + 1))
{last}"""


@query("C17_weight_tuning", _tune_sql("SELECT user_id, " + ", ".join(f"round({p}, 9) AS {p}" for p in K.PARTS) + ", CAST(r AS INTEGER) AS feedback_count FROM walk w WHERE r = (SELECT count(*) FROM log WHERE log.user_id = w.user_id)"))
def weight_tuning(role):
    return K.tune(_feedback_log(role), key="user_id", order="event_id").select("user_id", *[F.round(p, 9).alias(p) for p in K.PARTS], "feedback_count")


@query("C34_decay_family", """SELECT id, round(greatest(0.0, least(1.0, greatest(0.01, i * exp(-0.1 * d) * (1 + least(0.1 * n, 0.5))))), 9) AS decay, round(i * pow(0.5, d / 7.0), 9) AS half_life,
 round(greatest(0.01, least(1.0, i * exp(-0.05 * d) * exp(-0.1 * d / 2) * (1 + log10(1 + n) / 3))), 9) AS multi_factor, round(i * (1 + 0.2 * exp(-0.1 * d)), 9) AS search_time,
 round(CASE WHEN i <= 0.3 THEN 0.0 ELSE ln(0.3 / i) / -0.1 END, 9) AS days_until, round(least(1.0, i + (1 - i) * 0.8), 9) AS boosted
FROM (SELECT doc_id AS id, CAST(doc_id % 10 + 1 AS DOUBLE) / 10 AS i, CAST(doc_id % 60 AS DOUBLE) AS d, doc_id % 30 AS n FROM {documents})""")
def decay_family(role):
    i, d, n = (F.col("doc_id") % 10 + 1).cast("double") / 10, (F.col("doc_id") % 60).cast("double"), F.col("doc_id") % 30
    out = {"decay": scores.decay(i, d, n), "half_life": scores.half_life(i, d), "multi_factor": scores.multi_factor_decay(i, d, d / 2, n), "search_time": scores.search_time_decay(i, d), "days_until": scores.days_until(i, 0.3), "boosted": scores.boost_on_access(i)}
    return role("documents").select(F.col("doc_id").alias("id"), *[F.round(v, 9).alias(k) for k, v in out.items()])


@query("H14_recency_score", "SELECT event_id, round(CASE WHEN event_id % 23 = 0 THEN 0.5 ELSE 1 / (1 + (1800000000 - (1700000000 + event_id * 60)) / 3600.0 / 168) END, 9) AS recency FROM {events}")
def recency_score(role):
    created = F.when(F.col("event_id") % 23 != 0, 1_700_000_000 + F.col("event_id") * 60)
    return role("events").select("event_id", F.round(scores.recency(created, 1_800_000_000), 9).alias("recency"))


@query("H15_pin_boost", "SELECT p_partkey, round(CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1.5 ELSE CASE WHEN p_size < 10 THEN 1.5 ELSE 1 + 0.5 * exp(-(p_size - 10) * ln(2) / 90) END END, 9) AS boost FROM {part}")
def pin_boost(role):
    kind = F.when(F.col("p_partkey") % 3 == 1, "hard").when(F.col("p_partkey") % 3 == 2, "soft").otherwise("none")
    return role("part").select("p_partkey", F.round(scores.pin_boost(kind, F.col("p_size") - 10), 9).alias("boost"))


@query("K3_hot_facts", "SELECT id, importance FROM {facts} ORDER BY importance DESC, id LIMIT 30")
def hot_facts(role):
    return role("facts").orderBy(F.desc("importance"), "id").limit(30).select("id", "importance")


@query("K4_digest_top", """
WITH s AS (SELECT id, owner, round(importance * (1 / (1 + (1800000000 - created_at) / 86400.0 / 30)), 12) AS score FROM {facts}), k AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY score DESC, id) AS rank FROM s)
SELECT owner, id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10""")
def digest_top(role):
    score = F.round(F.col("importance") * (1 / (1 + (F.lit(1_800_000_000) - F.col("created_at")) / 86400.0 / 30)), 12)
    rows = role("facts").select("id", "owner", score.alias("score")).withColumn("rank", F.row_number().over(W.partitionBy("owner").orderBy(F.desc("score"), "id")))
    return rows.filter("rank <= 10").select("owner", "id", F.round("score", 9).alias("score"), "rank")


@query("K7_debrief_items", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM {conversations} WHERE length(text) % 10 >= 6) WHERE k <= 5")
def debrief_items(role):
    rows = role("conversations").filter(F.length("text") % 10 >= 6)
    return rows.withColumn("k", F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))).filter("k <= 5").select("conv_id", "turn")


@query("K8_context_block", """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY importance DESC, created_at DESC, id) AS r FROM {facts}), top AS (SELECT *, importance >= 0.7 AS high FROM t WHERE r <= 20),
o AS (SELECT *, row_number() OVER (PARTITION BY owner, high ORDER BY created_at DESC, id) AS k FROM top)
SELECT owner, id, high FROM o WHERE high OR k <= 10""")
def context_block(role):
    top = role("facts").withColumn("r", F.row_number().over(W.partitionBy("owner").orderBy(F.desc("importance"), F.desc("created_at"), "id"))).filter("r <= 20").withColumn("high", F.col("importance") >= 0.7)
    return top.withColumn("k", F.row_number().over(W.partitionBy("owner", "high").orderBy(F.desc("created_at"), "id"))).filter("high or k <= 10").select("owner", "id", "high")


@query("J13_decision_lookup", RESOLVED_SQL + " SELECT a AS loser, max_by(b, b) AS winner, count(*) AS decisions FROM resolved WHERE action = 'supersede_existing' GROUP BY a")
def decision_lookup(role):
    """The newest decision in which a fact lost."""
    return _resolved(role).filter("action = 'supersede_existing'").groupBy(F.col("a").alias("loser")).agg(F.max_by("b", "b").alias("winner"), F.count("*").alias("decisions"))


@query("C21_digest_staleness", "SELECT user_id, count(*) FILTER (ts > TIMESTAMP '2024-01-20') AS fresh, max(ts) > TIMESTAMP '2024-01-20' AS stale, max(ts) > TIMESTAMP '2024-01-20' AND (count(*) FILTER (ts > TIMESTAMP '2024-01-20') >= 10 OR max(ts) >= TIMESTAMP '2024-01-29') AS recompile FROM {events} GROUP BY 1")
def digest_staleness(role):
    ts, version = F.col("ts").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")
    fresh, last = F.count_if(ts > version), F.max(ts)
    return role("events").groupBy("user_id").agg(fresh.alias("fresh"), (last > version).alias("stale"), ((last > version) & ((fresh >= 10) | (last >= F.lit("2024-01-29").cast("timestamp")))).alias("recompile"))
