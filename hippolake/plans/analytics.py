"""Queries: aggregates, graphs, chains, telemetry."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hippolake.functions import text as T
from hippolake.operators import graph as G
from hippolake.operators import telemetry as M
from hippolake.plans.catalog import query


def _at():
    return F.col("ts").cast("timestamp").cast("double")


@query("A1_count_active", "SELECT user_id, count(*) FILTER (is_active) AS active FROM {stored} GROUP BY 1")
def count_active(role):
    return role("stored").groupBy("user_id").agg(F.count_if("is_active").alias("active"))


@query("A2_corpus_stats", r"WITH t AS (SELECT lang, doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: strlen(x) >= 2) AS w FROM {documents}) SELECT lang, count(*) AS n, round(avg(len(w)), 6) AS avg_length FROM t GROUP BY 1")
def corpus_stats(role):
    return role("documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(F.size(T.tokens(F.col("text")))), 6).alias("avg_length"))


@query("A3_term_frequency", r"SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: strlen(x) >= 2)) AS token FROM {documents}) GROUP BY 1, 2")
def term_frequency(role):
    return role("documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


_ROLLING = """, kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM {events}) WHERE age <= 100),
m AS (SELECT user_id, avg(value) AS mean, avg(CASE WHEN value >= 30 THEN 1.0 ELSE 0.0 END) AS cap_rate, list_sort(list(value))[least(CAST(floor(count(*) * 0.95) AS BIGINT), count(*) - 1) + 1] AS p95, count(*) AS samples FROM kept GROUP BY 1)"""


@query("A4_rolling_telemetry", "WITH one AS (SELECT 1)" + _ROLLING + " SELECT user_id, round(mean, 6) AS mean, round(cap_rate, 6) AS cap_rate, p95, samples FROM m")
def rolling_telemetry(role):
    rows = M.rolling(role("events"), key="user_id", order=["ts", "event_id"], value="value", cap=30)
    return rows.select("user_id", F.round("mean", 6).alias("mean"), F.round("cap_rate", 6).alias("cap_rate"), "p95", "samples")


@query("A5_user_metrics", "WITH one AS (SELECT 1)" + _ROLLING + ", f AS (SELECT user_id, count(*) FILTER (is_active) AS active FROM {stored} GROUP BY 1) SELECT f.user_id, f.active, coalesce(round(m.mean, 6), 0) AS mean, coalesce(m.samples, 0) AS samples FROM f LEFT JOIN m ON m.user_id = f.user_id")
def user_metrics(role):
    rows = M.rolling(role("events"), key="user_id", order=["ts", "event_id"], value="value", cap=30)
    active = role("stored").groupBy("user_id").agg(F.count_if("is_active").alias("active"))
    return active.join(rows, "user_id", "left").select("user_id", "active", F.coalesce(F.round("mean", 6), F.lit(0.0)).alias("mean"), F.coalesce("samples", F.lit(0)).alias("samples"))


# The upper bounds of a duration's eleven buckets, in seconds.
_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


@query("A6_http_metrics", "SELECT event_type, le, count(*) FILTER (value / 10 <= le) AS count FROM {events}, (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, CAST('inf' AS DOUBLE)]) AS le) GROUP BY 1, 2")
def http_metrics(role):
    return M.histogram(role("events").withColumn("seconds", F.col("value") / 10), "seconds", _BOUNDS, key="event_type")


@query("A7_digest_counts", "SELECT owner, count(*) AS facts, count(DISTINCT label) AS entities, max(created_at) AS latest FROM {facts} GROUP BY 1")
def digest_counts(role):
    return role("facts").groupBy("owner").agg(F.count("*").alias("facts"), F.count_distinct("label").alias("entities"), F.max("created_at").alias("latest"))


@query("A8_active_projects", "WITH n AS (SELECT lower(p_name) AS norm, min_by(p_name, p_partkey) AS display, count(*) AS n FROM {part} GROUP BY 1) SELECT display, n FROM n ORDER BY n DESC, norm LIMIT 10")
def active_projects(role):
    counted = role("part").groupBy(F.lower("p_name").alias("norm")).agg(F.min_by("p_name", "p_partkey").alias("display"), F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "norm").limit(10).select("display", "n")


@query("A10_source_breakdown", "SELECT source, count(*) AS n FROM {facts} GROUP BY 1")
def source_breakdown(role):
    return role("facts").groupBy("source").agg(F.count("*").alias("n"))


_MENTIONS = "SELECT user_id AS entity, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS session FROM {events}"


def _mentions(role):
    return role("events").select(F.col("user_id").alias("entity"), F.floor(_at() / 21600).alias("session"))


@query("A11_graph_nodes", f"WITH m AS (SELECT DISTINCT * FROM ({_MENTIONS})) SELECT entity, count(*) AS weight FROM m GROUP BY 1 ORDER BY weight DESC, entity LIMIT 60")
def graph_nodes(role):
    return G.nodes(_mentions(role), 60, session="session", entity="entity")


@query("C25_entity_graph", f"WITH m AS (SELECT DISTINCT * FROM ({_MENTIONS})), kept AS (SELECT entity, count(*) AS weight FROM m GROUP BY 1 ORDER BY weight DESC, entity LIMIT 60) SELECT x.entity AS a, y.entity AS b, count(*) AS weight FROM m x JOIN m y ON x.session = y.session AND x.entity < y.entity WHERE x.entity IN (SELECT entity FROM kept) AND y.entity IN (SELECT entity FROM kept) GROUP BY 1, 2")
def entity_graph(role):
    rows = _mentions(role)
    return G.co_occurrence(rows, G.nodes(rows, 60, session="session", entity="entity"), session="session", entity="entity")


@query("J12_co_occurrence", "SELECT x.label AS a, y.label AS b, count(*) AS weight FROM (SELECT DISTINCT owner, label FROM {facts} WHERE label IS NOT NULL) x JOIN (SELECT DISTINCT owner, label FROM {facts} WHERE label IS NOT NULL) y ON x.owner = y.owner AND x.label < y.label GROUP BY 1, 2")
def co_occurrence(role):
    rows = role("facts").filter("label is not null").select("owner", "label")
    return G.co_occurrence(rows, rows.select("label").distinct(), session="owner", entity="label")


@query("A12_dominant_scope", "SELECT user_id, arg_max(event_type, n * 1000000000 - first) AS dominant FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM {events} GROUP BY 1, 2) GROUP BY 1")
def dominant_scope(role):
    return G.dominant(role("events"), "user_id", "event_type", "event_id")


@query("C26_mind_map", "SELECT 'you' AS a, source AS b, count(*) AS weight FROM {facts} GROUP BY source UNION ALL SELECT source, 'e' || label, count(*) FROM {facts} WHERE label IS NOT NULL GROUP BY source, label")
def mind_map(role):
    facts = role("facts")
    hub = facts.groupBy("source").agg(F.count("*").alias("weight")).select(F.lit("you").alias("a"), F.col("source").alias("b"), "weight")
    spokes = facts.filter("label is not null").groupBy("source", "label").agg(F.count("*").alias("weight"))
    return hub.unionByName(spokes.select(F.col("source").alias("a"), F.concat(F.lit("e"), F.col("label").cast("string")).alias("b"), "weight"))


_LINKS = "SELECT o_orderkey AS id, o_orderkey + 1 + o_orderkey % 3 AS next FROM {orders} WHERE o_orderkey % 7 < 4"


@query("J11_supersession_chains", f"""WITH RECURSIVE l AS ({_LINKS}), up AS (SELECT next AS id, min(id) AS up FROM l GROUP BY 1), ids AS (SELECT id FROM l UNION SELECT next FROM l),
walk AS (SELECT i.id, i.id AS root, CAST(0 AS BIGINT) AS depth FROM ids i WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.id = i.id) UNION ALL SELECT u.id, w.root, w.depth + 1 FROM walk w JOIN up u ON u.up = w.id)
SELECT id, root, depth FROM walk""")
def supersession_chains(role):
    links = role("orders").filter("o_orderkey % 7 < 4").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") + 1 + F.col("o_orderkey") % 3).alias("next"))
    return G.chains(links)


@query("C27_lineage", f"""WITH RECURSIVE l AS ({_LINKS}), up AS (SELECT next AS id, min(id) AS up FROM l GROUP BY 1), ids AS (SELECT id FROM l UNION SELECT next FROM l),
walk AS (SELECT i.id, i.id AS root, CAST(0 AS BIGINT) AS depth FROM ids i WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.id = i.id) UNION ALL SELECT u.id, w.root, w.depth + 1 FROM walk w JOIN up u ON u.up = w.id)
SELECT root, count(*) AS length, string_agg(CAST(id AS VARCHAR), '>' ORDER BY depth DESC, id) AS chain FROM walk GROUP BY root HAVING count(*) > 1""")
def lineage(role):
    """Chains of more than one claim, newest first."""
    rows = supersession_chains(role)
    chain = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "id"))), lambda r: r["id"].cast("string")), ">")
    return rows.groupBy("root").agg(F.count("*").alias("length"), chain.alias("chain")).filter("length > 1")


@query("A13_quota_estimate", "SELECT l_returnflag, count(*) AS atomic, count(DISTINCT l_orderkey) FILTER (l_linenumber > 1) AS multi_sessions, count_if(l_linenumber = 1) AS singletons FROM {lineitem} GROUP BY 1")
def quota_estimate(role):
    return role("lineitem").groupBy("l_returnflag").agg(F.count("*").alias("atomic"), F.count_distinct(F.when(F.col("l_linenumber") > 1, F.col("l_orderkey"))).alias("multi_sessions"), F.count_if(F.col("l_linenumber") == 1).alias("singletons"))


@query("A14_import_estimate", "WITH c AS (SELECT conv_id, CAST(ceil(count(*) / 3.0) AS BIGINT) AS chunks FROM {conversations} GROUP BY 1) SELECT count(*) AS conversations, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(ceil(sum(chunks) * 2.5) AS BIGINT) AS facts, CAST(ceil((sum(chunks) * 50 + sum(chunks) * 2.5 * 0.5 + 1200) / 60) AS BIGINT) AS minutes FROM c")
def import_estimate(role):
    """Fixed values of the estimate: 50 s and 2.5 facts a chunk, 0.5 s a write, 1200 s for the profile."""
    chunks = F.sum("chunks")
    per = role("conversations").groupBy("conv_id").agg(F.ceil(F.count("*") / 3.0).alias("chunks"))
    return per.agg(F.count("*").alias("conversations"), chunks.alias("chunks"), F.ceil(chunks * 2.5).alias("facts"), F.ceil((chunks * 50 + chunks * 2.5 * 0.5 + 1200) / 60).alias("minutes"))


@query("A15_zero_fact_reasons", "SELECT CASE WHEN length(text) < 40 THEN 'too_short' WHEN role = 'system' THEN 'not_user' WHEN text LIKE '%?%' THEN 'question' ELSE 'none' END AS reason, count(*) AS n FROM {conversations} GROUP BY 1")
def zero_fact_reasons(role):
    reason = F.when(F.length("text") < 40, "too_short").when(F.col("role") == "system", "not_user").when(F.contains("text", F.lit("?")), "question").otherwise("none")
    return role("conversations").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


#: Items that a task is dealt.
TASK_ITEMS = 250_000


@query("A16_retrieval_quality", """
WITH ranked AS (SELECT l_orderkey AS query_id, l_partkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS rank FROM {lineitem}),
rel AS (SELECT DISTINCT l_orderkey AS query_id, l_partkey AS id, o_orderpriority AS category FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_quantity > 30),
expected AS (SELECT query_id, category, count(*) AS expected FROM rel GROUP BY 1, 2),
found AS (SELECT r.query_id, count(*) AS found, min(r.rank) AS first FROM ranked r WHERE r.rank <= 8 AND EXISTS (SELECT 1 FROM rel WHERE rel.query_id = r.query_id AND rel.id = r.id) GROUP BY 1),
per AS (SELECT category, coalesce(found, 0) / expected AS recall, coalesce(found, 0) / 8 AS precision, coalesce(1.0 / first, 0) AS rr FROM expected LEFT JOIN found USING (query_id))
SELECT category, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(rr), 6) AS mrr, count(*) AS queries, round(quantile_disc(recall, 0.5), 6) AS recall_p50, round(quantile_disc(recall, 0.95), 6) AS recall_p95, round(quantile_disc(rr, 0.5), 6) AS rr_p50 FROM per GROUP BY ROLLUP (category)""")
def retrieval_quality(role):
    items = role("lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id"), "l_extendedprice", "l_linenumber", "l_quantity")
    # A task's share is bounded, whatever the session's number of partitions.
    tasks = max(items.sparkSession.sparkContext.defaultParallelism, -(-role("lineitem").count() // TASK_ITEMS))
    dealt = items.drop("l_quantity").repartition(tasks, "query_id")
    ranked = dealt.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("l_extendedprice"), "id", "l_linenumber")))
    orders = role("orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("category")).repartition(tasks, "query_id")
    relevant = items.filter("l_quantity > 30").select("query_id", "id").repartition(tasks, "query_id").join(orders, "query_id").select("query_id", "id", "category").distinct()
    out = M.retrieval_quality(ranked, relevant, 8, tasks=tasks)
    return out.select("category", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr", "recall_p50", "recall_p95", "rr_p50")], "queries")


@query("A17_filter_outcomes", "SELECT owner, count(*) FILTER (importance >= 0.5) AS kept, count(*) FILTER (importance < 0.5) AS dropped FROM {facts} GROUP BY 1")
def filter_outcomes(role):
    return role("facts").groupBy("owner").agg(F.count_if(F.col("importance") >= 0.5).alias("kept"), F.count_if(F.col("importance") < 0.5).alias("dropped"))


@query("A18_distinct_sources", "SELECT owner, string_agg(source, ',' ORDER BY source) AS sources FROM (SELECT DISTINCT owner, source FROM {facts}) GROUP BY 1")
def distinct_sources(role):
    return role("facts").groupBy("owner").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


@query("A19_provenance_summary", "SELECT source, lang, count(*) AS facts, count(label) AS with_entity, count(DISTINCT owner) AS owners FROM {facts} GROUP BY 1, 2")
def provenance_summary(role):
    return role("facts").groupBy("source", "lang").agg(F.count("*").alias("facts"), F.count("label").alias("with_entity"), F.count_distinct("owner").alias("owners"))


@query("A20_quota_usage", "SELECT c_custkey, round(CASE WHEN c_nationkey = 0 THEN 0 ELSE greatest(c_acctbal, 0) / (c_nationkey * 500) END, 6) AS usage, CASE WHEN c_nationkey = 0 THEN false ELSE greatest(c_acctbal, 0) / (c_nationkey * 500) > 0.8 END AS warn FROM {customer}")
def quota_usage(role):
    limit = F.col("c_nationkey") * 500
    usage = F.when(limit == 0, 0.0).otherwise(F.greatest("c_acctbal", F.lit(0.0)) / F.when(limit != 0, limit))
    return role("customer").select("c_custkey", F.round(usage, 6).alias("usage"), (usage > 0.8).alias("warn"))


@query("R10_last_100_frame", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS mean FROM {events}")
def last_100_frame(role):
    return role("events").select("event_id", F.round(F.avg("value").over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-99, 0)), 9).alias("mean"))


@query("R11_rate_limit", """
WITH RECURSIVE hits AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS secs FROM {events}), rows AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY secs, event_id) AS r FROM hits),
walk AS (SELECT user_id, event_id, r, [secs] AS recent, true AS allowed FROM rows WHERE r = 1
  UNION ALL SELECT x.user_id, x.event_id, x.r, CASE WHEN len(list_filter(w.recent, lambda t: t > x.secs - 36000)) < 3 THEN list_append(list_filter(w.recent, lambda t: t > x.secs - 36000), x.secs) ELSE list_filter(w.recent, lambda t: t > x.secs - 36000) END,
    len(list_filter(w.recent, lambda t: t > x.secs - 36000)) < 3 FROM walk w JOIN rows x ON x.user_id = w.user_id AND x.r = w.r + 1)
SELECT user_id, event_id, allowed FROM walk""")
def rate_limit(role):
    hits = role("events").select("user_id", "event_id", F.floor(_at()).alias("at"))
    return M.rate_limit(hits, key="user_id", order=["at", "event_id"], at="at", most=3, window=36000)


@query("R1_competition_rank", "SELECT l_orderkey, l_linenumber, CAST(rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS INTEGER) AS place FROM {lineitem}")
def competition_rank(role):
    return role("lineitem").select("l_orderkey", "l_linenumber", F.rank().over(W.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"))).alias("place"))


@query("R2_position_rank", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM {orders}")
def position_rank(role):
    return role("orders").select("o_custkey", "o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("place"))


@query("K1_top_k_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM {orders}) WHERE k <= 8")
def top_k_per_key(role):
    return role("orders").withColumn("k", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).filter("k <= 8").select("o_custkey", "o_orderkey", "o_totalprice")
