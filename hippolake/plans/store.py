"""Queries: scans, deltas, writes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hippolake.functions import lsh as L
from hippolake.functions import text as T
from hippolake.operators import store as S
from hippolake.operators import retrieval as R
from hippolake.plans.catalog import query
from hippolake.plans.filters import vocabulary_sql
from hippolake.plans.retrieval import LSH_DIMS, LSH_SECRET


@query("S1_export_active", "SELECT id, user_id, created_at FROM {stored} WHERE is_active")
def export_active(role):
    return S.export_active(role("stored")).select("id", "user_id", "created_at")


@query("S2_keyset_page", """
WITH rows AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS place FROM {stored}
  WHERE is_active AND (created_at < TIMESTAMP '1998-01-01' OR (created_at = TIMESTAMP '1998-01-01' AND id < 5000))),
seen AS (SELECT *, max(place) OVER (PARTITION BY user_id) > 3 AS has_more FROM rows WHERE place <= 4)
SELECT user_id, id, created_at, CAST(place AS INTEGER) AS place, has_more FROM seen WHERE place <= 3""")
def keyset_page(role):
    return S.keyset_page(role("stored"), 3, ("1998-01-01 00:00:00", 5000)).select("user_id", "id", "created_at", "place", "has_more")


@query("S2_keyset_requests", """
WITH active AS (SELECT * FROM {stored} WHERE is_active), asked AS (SELECT DISTINCT c_custkey AS user_id, CASE c_custkey % 3 WHEN 0 THEN NULL ELSE latest END AS cursor
  FROM {customer} JOIN (SELECT user_id, CASE WHEN user_id % 3 = 1 THEN max(id) ELSE min(id) + 1 END AS latest FROM {stored} GROUP BY 1) ON user_id = c_custkey),
known AS (SELECT a.*, f.created_at AS cursor_at FROM asked a LEFT JOIN active f ON f.id = a.cursor AND f.user_id = a.user_id),
rows AS (SELECT k.user_id, k.cursor, f.id, f.created_at, row_number() OVER (PARTITION BY k.user_id ORDER BY f.created_at DESC, f.id DESC) AS place FROM known k JOIN active f ON f.user_id = k.user_id
  WHERE k.cursor IS NULL OR f.created_at < k.cursor_at OR (f.created_at = k.cursor_at AND f.id < k.cursor)),
pages AS (SELECT user_id, string_agg(id, ',' ORDER BY place) FILTER (place <= 3) AS page, max(place) > 3 AS has_more, max(id) FILTER (place = 3) AS last FROM rows WHERE place <= 4 GROUP BY 1)
SELECT a.user_id, a.cursor, coalesce(page, '') AS page, coalesce(has_more, false) AS has_more, CASE WHEN has_more THEN last END AS next_cursor, (SELECT count(*) FROM active f WHERE f.user_id = a.user_id) AS total_count FROM asked a LEFT JOIN pages p USING (user_id)""")
def keyset_requests(role):
    """A page of three for every customer: the first one, one after a known fact, or one after a cursor that may be nobody's."""
    stored = role("stored")
    edges = stored.groupBy("user_id").agg(F.max("id").alias("latest"), F.min("id").alias("earliest"))
    cursor = F.when(F.col("user_id") % 3 == 1, F.col("latest")).when(F.col("user_id") % 3 == 2, F.col("earliest") + 1)
    asked = role("customer").select(F.col("c_custkey").alias("user_id")).join(edges, "user_id").select("user_id", cursor.alias("cursor"))
    pages = S.keyset_pages(stored, asked, 3)
    return pages.select("user_id", "cursor", F.array_join(F.transform("page", lambda x: x["id"].cast("string")), ",").alias("page"), "has_more", "next_cursor", "total_count")


@query("S3_offset_page", "SELECT id, user_id, created_at FROM {stored} WHERE is_active ORDER BY created_at DESC, id LIMIT 1000 OFFSET 2000")
def offset_page(role):
    return role("stored").filter("is_active").orderBy(F.desc("created_at"), "id").offset(2000).limit(1000).select("id", "user_id", "created_at")


@query("S4_delta_by_sequence", """
WITH rows AS (SELECT *, max(sequence_id) OVER (PARTITION BY user_id) AS latest, row_number() OVER (PARTITION BY user_id ORDER BY sequence_id ASC NULLS LAST, id) AS place FROM {stored} WHERE sequence_id > 1000)
SELECT user_id, id, sequence_id, latest, CAST(place AS INTEGER) AS place FROM rows WHERE place <= 5""")
def delta_by_sequence(role):
    return S.delta(role("stored"), 1000, 5).select("user_id", "id", "sequence_id", "latest", "place")


@query("S5_delta_by_block", "SELECT event_id, fact_id, ts FROM {log} WHERE event_id > 5000")
def delta_by_block(role):
    return role("log").filter("event_id > 5000").orderBy("event_id").select("event_id", "fact_id", "ts")


@query("S6_point_lookup", "SELECT c_custkey AS id, c_name AS owner, c_acctbal >= 0 AS is_active FROM {customer} WHERE lower(c_name) = lower('CUSTOMER#000000042') AND c_acctbal >= -1e9")
def point_lookup(role):
    rows = role("customer").filter((F.lower("c_name") == "customer#000000042") & (F.col("c_acctbal") >= -1e9))
    return rows.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("owner"), (F.col("c_acctbal") >= 0).alias("is_active"))


@query("W1_store_once", """
WITH known AS (SELECT DISTINCT user_id, content_fp FROM {stored} WHERE is_active AND id % 2 = 0),
new AS (SELECT *, row_number() OVER (PARTITION BY user_id, content_fp ORDER BY id) = 1 AS first FROM {stored} WHERE id % 2 = 1)
SELECT n.id, n.user_id, n.content_fp, k.content_fp IS NULL AND n.first AS stored FROM new n LEFT JOIN known k ON k.user_id = n.user_id AND k.content_fp = n.content_fp""")
def store_once(role):
    rows = role("stored")
    return S.store_once(rows.filter("id % 2 = 1"), rows.filter("id % 2 = 0")).select("id", "user_id", "content_fp", "stored")


#: The key of the registered query's fingerprints; a deployment derives its own.
DEDUP_KEY = b"k" * 32


@query("W2_fact_preparation", "WITH RECURSIVE " + L.planes_sql(LSH_SECRET, LSH_DIMS).replace("{", "{{").replace("}", "}}").strip() + ", " + vocabulary_sql("doc_id", "documents").strip().removeprefix("WITH ") + r""", sizes AS (SELECT id, count(*) AS n FROM first GROUP BY 1),
sides AS (SELECT vec_id, t, string_agg(CASE WHEN list_dot_product(CAST(embedding AS DOUBLE[]), weights) >= 0 THEN '1' ELSE '0' END, '' ORDER BY b) AS bits FROM {embeddings}, planes WHERE len(embedding) = %d GROUP BY vec_id, t),
buckets AS (SELECT vec_id, count(*) AS n, sha256(string_agg(sha256('lsh_t' || t || '_' || bits), ',' ORDER BY t)) AS buckets_digest FROM sides GROUP BY vec_id)
SELECT doc_id AS id, greatest(0.0, least(1.0, CAST(doc_id %% 14 AS DOUBLE) / 10)) AS decay_score, coalesce(s.n, 0) + coalesce(b.n, 0) AS n_indices, b.buckets_digest,
 sha256('%s'::BLOB || unhex(sha256('%s'::BLOB || encode(trim(regexp_replace(lower(nfc_normalize(text)), '\s+', ' ', 'g')))))) AS digest FROM {documents} LEFT JOIN sizes s ON s.id = doc_id LEFT JOIN buckets b ON b.vec_id = doc_id""" % (LSH_DIMS, r"\x37" * 32 + r"\x5C" * 32, r"\x5D" * 32 + r"\x36" * 32))
def fact_preparation(role):
    """What a fact's record holds: clamped score, how many digests its index has (words, stems, buckets of its vector), its buckets' digest and its keyed fingerprint."""
    docs = role("documents")
    decay = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("doc_id") % 14).cast("double") / 10))
    sizes = R.index_sizes(docs, id_col="doc_id").withColumnRenamed("doc_id", "id")
    # A vector's buckets are counted and digested before they are joined.
    signed = role("embeddings").select(F.col("vec_id").alias("id"), L.signature(F.col("embedding"), LSH_SECRET, LSH_DIMS).alias("signed")).filter("signed IS NOT NULL")
    vectors = signed.select("id", F.size("signed").alias("n_buckets"), F.sha2(F.array_join(L.bucket_hashes(F.col("signed")), ","), 256).alias("buckets_digest"))
    made = docs.select(F.col("doc_id").alias("id"), decay.alias("decay_score"), T.fingerprint(F.col("text"), DEDUP_KEY).alias("digest"))
    joined = made.join(sizes, "id", "left").join(vectors, "id", "left")
    count = F.coalesce("n", F.lit(0)) + F.coalesce("n_buckets", F.lit(0))
    return joined.select("id", "decay_score", count.cast("long").alias("n_indices"), "buckets_digest", "digest")


@query("W3_log_replay", """
WITH ordered AS (SELECT *, points / 100.0 AS decay, row_number() OVER (PARTITION BY fact_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY fact_id) AS writes FROM {log})
SELECT fact_id, event_id, ts, CAST(decay AS DOUBLE) AS decay_score, writes, decay >= 0.3 AS is_active FROM ordered WHERE k = 1""")
def log_replay(role):
    log = role("log").select("fact_id", "ts", "event_id", (F.col("points") / 100.0).alias("decay_score"))
    return S.replay(log, order=["ts", "event_id"]).select("fact_id", "event_id", "ts", "decay_score", "writes", "is_active")


@query("W4_optimistic_update", """
WITH updates AS (SELECT o_orderkey AS id, o_orderkey % 5 + 1 + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS expected, o_totalprice * 2 AS new_price FROM {orders} WHERE o_orderkey % 3 = 0)
SELECT s.id, s.user_id, CASE WHEN u.expected = s.version THEN u.new_price ELSE s.price END AS price, CASE WHEN u.expected = s.version THEN s.version + 1 ELSE s.version END AS version, u.expected = s.version AS applied
FROM {stored} s LEFT JOIN updates u USING (id)""")
def optimistic_update(role):
    updates = role("orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5 + 1 + F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(0)).alias("expected"), (F.col("o_totalprice") * 2).alias("new_price"))
    return S.update_if(role("stored"), updates).select("id", "user_id", "price", "version", "applied")


@query("W5_soft_delete", "SELECT s.id, s.is_active AND NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = s.id AND l.l_returnflag = 'R') AS is_active FROM {stored} s")
def soft_delete(role):
    returned = role("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return S.tombstone(role("stored"), returned).select("id", "is_active")


@query("W6_account_delete", "SELECT s.id, s.user_id, s.is_active AND c.c_acctbal >= 0 AS is_active FROM {stored} s JOIN {customer} c ON c.c_custkey = s.user_id")
def account_delete(role):
    closed = role("customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    known = role("stored").join(role("customer").select(F.col("c_custkey").alias("user_id")), "user_id", "left_semi")
    return S.tombstone(known, closed, key="user_id").select("id", "user_id", "is_active")


@query("W8_export_markdown", """SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY id) AS n, '- [' || source || '] ' || text || ' (' || CAST(CAST(round(importance * 10) AS INTEGER) AS VARCHAR) || ')' AS line FROM {facts}""")
def export_markdown(role):
    """The lines of each owner's page in their order: a row each, so no task holds a page."""
    line = F.format_string("- [%s] %s (%d)", F.col("source"), F.col("text"), F.round(F.col("importance") * 10).cast("int"))
    return role("facts").select("owner", F.row_number().over(W.partitionBy("owner").orderBy("id")).cast("long").alias("n"), line.alias("line"))


@query("W9_rotate_log", "SELECT fact_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY ts DESC, event_id DESC) AS age FROM {log}) WHERE age <= 10")
def rotate_log(role):
    return S.keep_newest(role("log"), 10, key="fact_id", order=["ts", "event_id"]).select("fact_id", "event_id")


@query("W10_capped_batches", """
WITH RECURSIVE rows AS (SELECT conv_id, turn, CAST(strlen(text) AS BIGINT) AS bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM {conversations}),
walk AS (SELECT conv_id, turn, bytes, r, 0 AS batch, 1 AS n, bytes AS total FROM rows WHERE r = 1
  UNION ALL SELECT x.conv_id, x.turn, x.bytes, x.r, w.batch + CASE WHEN w.n >= 3 OR w.total + x.bytes > 1500 THEN 1 ELSE 0 END, CASE WHEN w.n >= 3 OR w.total + x.bytes > 1500 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n >= 3 OR w.total + x.bytes > 1500 THEN x.bytes ELSE w.total + x.bytes END
  FROM walk w JOIN rows x ON x.conv_id = w.conv_id AND x.r = w.r + 1)
SELECT conv_id, turn, bytes, batch FROM walk""")
def capped_batches(role):
    rows = role("conversations").select("conv_id", "turn", F.octet_length("text").cast("long").alias("bytes"))
    return S.batches(rows, key="conv_id", order="turn", size="bytes", most_rows=3, most_bytes=1500)


@query("W11_curation_rewrite", """
WITH edits AS (SELECT id, 'user' AS target FROM {facts} WHERE id % 6 = 0), met AS (SELECT f.id, f.source, e.target FROM {facts} f LEFT JOIN edits e USING (id))
SELECT id, source, false AS tombstone FROM met WHERE target IS NULL OR target = source
UNION ALL SELECT id, source, true FROM met WHERE target <> source
UNION ALL SELECT id + 1000000000, target, false FROM met WHERE target <> source""")
def curation_rewrite(role):
    facts = role("facts").select("id", "source")
    met = facts.join(facts.filter("id % 6 = 0").select("id", F.lit("user").alias("target")), "id", "left")
    changes = F.col("target").isNotNull() & (F.col("target") != F.col("source"))
    rows = F.when(changes, F.array(F.struct("id", "source", F.lit(True).alias("tombstone")), F.struct((F.col("id") + 1_000_000_000).alias("id"), F.col("target").alias("source"), F.lit(False).alias("tombstone")))).otherwise(F.array(F.struct("id", "source", F.lit(False).alias("tombstone"))))
    return met.select(F.inline(rows))


@query("W12_import_dedup", r"""
WITH n AS (SELECT doc_id AS id, source, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS norm FROM {documents}), known AS (SELECT DISTINCT sha256(norm) AS fp FROM n WHERE id % 5 = 0)
SELECT id, source FROM (SELECT id, source, row_number() OVER (PARTITION BY norm, source ORDER BY id) AS k FROM n WHERE id % 5 <> 0 AND sha256(norm) NOT IN (SELECT fp FROM known)) WHERE k = 1""")
def import_dedup(role):
    rows = role("documents").select(F.col("doc_id").alias("id"), "source", F.sha2(T.normalise(F.col("text")), 256).alias("fp"))
    known = rows.filter("id % 5 = 0").select("fp").distinct()
    new = rows.filter("id % 5 <> 0").join(known, "fp", "left_anti")
    return new.withColumn("k", F.row_number().over(W.partitionBy("fp", "source").orderBy("id"))).filter("k = 1").select("id", "source")


@query("W13_import_registry", "SELECT DISTINCT user_id AS conv_id FROM {events} WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM {events} WHERE event_type = 'signup' AND value < 20)")
def import_registry(role):
    seen = role("events").filter("event_type = 'signup' and value < 20").select("user_id").distinct()
    return role("events").filter("event_type = 'click'").select("user_id").distinct().join(seen, "user_id", "left_anti").select(F.col("user_id").alias("conv_id"))


@query("W14_retention_purge", "SELECT event_id, event_type FROM {events} WHERE NOT (event_type = 'error' AND ts < TIMESTAMP '2024-01-31' - INTERVAL 15 DAY) AND NOT (event_type = 'view' AND ts < TIMESTAMP '2024-01-31' - INTERVAL 25 DAY)")
def retention_purge(role):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    old = lambda kind, days: (F.col("event_type") == kind) & (F.col("ts") < now - F.expr(f"INTERVAL {days} DAY"))
    return role("events").filter(~old("error", 15) & ~old("view", 25)).select("event_id", "event_type")


@query("R9_monotonic_sequence", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS seq FROM {log}")
def monotonic_sequence(role):
    return S.sequence(role("log").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "seq")


@query("J8_fingerprint_membership", r"SELECT item_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) IN (SELECT sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) FROM {documents}) AS stored FROM {benchmark}")
def fingerprint_membership(role):
    fp = F.sha2(T.normalise(F.col("text")), 256).alias("fp")
    known = role("documents").select(fp).distinct().withColumn("known", F.lit(True))
    return role("benchmark").select("item_id", fp).join(known, "fp", "left").select("item_id", F.col("known").isNotNull().alias("stored"))


@query("J9_reconcile", "SELECT o_orderkey AS id, CASE WHEN EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45) THEN 'skip' ELSE 'push' END AS action FROM {orders} o")
def reconcile(role):
    local = role("orders").select(F.col("o_orderkey").alias("id"))
    server = role("lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("id")).distinct()
    return local.join(server, "id", "left_semi").withColumn("action", F.lit("skip")).unionByName(local.join(server, "id", "left_anti").withColumn("action", F.lit("push")))
