"""Queries: candidate lookup, ranking and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hippolake.functions import lsh as L
from hippolake.functions import text as T
from hippolake.functions import vectors as V
from hippolake.functions.stem import stems_sql
from hippolake.operators import retrieval as R
from hippolake.plans.catalog import query
from hippolake.storage import materialize

POOL, KEEP = 3000, 8

_TOKENS = r"list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: strlen(x) >= 2)".replace("{{", "{").replace("}}", "}")
_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_OKAPI_TOKENS = _TOKENS.replace("strlen(x) >= 2", f"length(x) >= 2 AND x NOT IN ({_STOPS})")

#: Common SQL: tokens, postings and each query's candidate pool.
POOL_SQL = f"""
WITH dtok AS (SELECT id, unnest({_TOKENS}) AS token FROM {{facts}}),
qtok AS (SELECT query_id, unnest({_TOKENS}) AS token FROM {{asked}}),
vocab AS (SELECT token FROM dtok UNION SELECT token FROM qtok),
stems AS ({stems_sql("vocab").replace("{", "{{").replace("}", "}}")}),
terms AS (SELECT token, sha256(token) AS hash FROM vocab UNION ALL SELECT token, sha256('stem:' || stem) FROM stems WHERE strlen(stem) >= 2),
post AS (SELECT DISTINCT id, hash FROM dtok JOIN terms USING (token)),
trap AS (SELECT DISTINCT query_id, hash FROM qtok JOIN terms USING (token)),
hits AS (SELECT DISTINCT t.query_id, p.id FROM trap t JOIN post p USING (hash)),
pool0 AS (SELECT h.query_id, h.id, f.decay_score, count(*) OVER (PARTITION BY h.query_id) AS total,
         row_number() OVER (PARTITION BY h.query_id ORDER BY f.decay_score DESC, h.id) AS rank FROM hits h JOIN {{facts}} f ON f.id = h.id),
pool AS (SELECT * FROM pool0 WHERE rank <= {POOL})
"""


def bm25_sql(variant: str, tokens: str) -> str:
    df = "sum(tf)" if variant == "core" else "count(*)"
    return f""",
btok AS (SELECT id, unnest({tokens}) AS token FROM {{facts}}),
bq AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest({tokens}) AS token FROM {{asked}}) GROUP BY ALL),
blen AS (SELECT id, len({tokens}) AS length FROM {{facts}}),
bheld AS (SELECT p.query_id, p.id, l.length FROM pool p JOIN blen l USING (id)),
bstats AS (SELECT query_id, count(*) AS n, avg(length) AS avg_length FROM bheld GROUP BY 1),
btf AS (SELECT id, token, count(*) AS tf FROM btok GROUP BY ALL),
bmet AS (SELECT q.query_id, h.id, q.token, q.times, t.tf, h.length FROM bq q JOIN btf t USING (token) JOIN bheld h ON h.query_id = q.query_id AND h.id = t.id),
bdf AS (SELECT query_id, token, {df} AS df FROM bmet GROUP BY 1, 2),
bsum AS (SELECT m.query_id, m.id, sum(m.times * ln((s.n - d.df + 0.5) / (d.df + 0.5) + 1) * m.tf * 2.2 / (m.tf + 1.2 * (0.25 + 0.75 * m.length / s.avg_length))) AS bm25
        FROM bmet m JOIN bdf d USING (query_id, token) JOIN bstats s USING (query_id) GROUP BY 1, 2),
scored AS (SELECT h.query_id, h.id, coalesce(b.bm25, 0.0) AS bm25 FROM bheld h LEFT JOIN bsum b USING (query_id, id))
"""


CORE_SQL = POOL_SQL + bm25_sql("core", _TOKENS)
OKAPI_SQL = POOL_SQL + bm25_sql("okapi", _OKAPI_TOKENS)

COSINE_SQL = """,
cos AS (SELECT s.query_id, s.id, s.bm25, f.source, f.decay_score, f.importance, f.created_at, f.embedding AS fe,
        CASE WHEN a.embedding IS NULL OR f.embedding IS NULL THEN 0.0
             ELSE list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(f.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])))) END AS cosine
        FROM scored s JOIN {asked} a ON a.query_id = s.query_id JOIN {facts} f ON f.id = s.id)
"""


def fused_sql(weigh: bool) -> str:
    weight = "CASE WHEN source IS NULL THEN 0.85 WHEN source = 'user' THEN 1.0 WHEN source = 'user-inferred' THEN 0.95 ELSE 0.85 END" if weigh else "1.0"
    return f"""
WITH ranked AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY round(bm25, 12) DESC) AS br, rank() OVER (PARTITION BY query_id ORDER BY round(cosine, 12) DESC) AS cr,
        greatest(0.0, least(1.0, cosine)) AS i, {weight} AS w FROM cos),
fused AS (SELECT *, ((0.3 + 0.3 * (1 - i)) / (60 + br) + (0.3 + 0.3 * i) / (60 + cr)) * w AS score FROM ranked),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS k FROM fused)
SELECT query_id, id, round(bm25, 6) AS bm25, round(cosine, 6) AS cosine, round(score, 6) AS score, k AS rank FROM best WHERE k <= {KEEP}
""".replace("WITH ranked", ", ranked", 1)


def _tokens(df: DataFrame, key: str, tokens=T.tokens) -> DataFrame:
    return df.select(key, tokens(F.col("text")).alias("tokens"))


def searched(role, most: int = POOL) -> tuple[R.Postings, DataFrame]:
    """The postings that the queries reach, and each query's pool, written down."""
    index = R.postings_for(role("fact_rows").select("id", "text"), role("asked").select("query_id", "text"))
    return index, materialize(R.overlap_search(index, role("fact_rows"), most=most), "pool")


def pool(role, most: int = POOL) -> DataFrame:
    index = R.postings_for(role("fact_rows").select("id", "text"), role("asked").select("query_id", "text"))
    return R.overlap_search(index, role("fact_rows"), most=most)


def ranked_by_words(role, variant: str = "core") -> DataFrame:
    index, candidates = searched(role)
    return R.bm25(candidates, index, _tokens(role("asked"), "query_id", T.tokens if variant == "core" else T.tokens_without_stops), variant=variant)


def scored(role, variant: str = "core") -> DataFrame:
    """The pool with bm25 and cosine, and the facts' columns that fusion reads, written down."""
    facts, asked = role("facts"), role("asked")
    with_facts = ranked_by_words(role, variant).join(role("fact_rows").select("id", "source", "decay_score", "importance", "created_at"), "id")
    return materialize(R.with_cosine(with_facts, asked, _vectors(role)), "scored")


def _vectors(role) -> DataFrame:
    """The facts' vectors, without their texts."""
    return role("embeddings").select(F.col("vec_id").alias("id"), "embedding").filter("embedding IS NOT NULL")


def _shown(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", *[F.round(c, 6).alias(c) for c in ("bm25", "cosine", "score")], F.col("rank").cast("long").alias("rank"))


@query("J1_overlap_search", POOL_SQL + "SELECT query_id, id, decay_score, total, rank FROM pool")
def overlap_search(role):
    return pool(role).select("query_id", "id", "decay_score", "total", F.col("rank").cast("long").alias("rank"))


#: Trapdoors asked at once, entries of a page, and facts after which no more pages are asked for.
CHUNK, PAGE, MOST = 5, 200, 500


@query("J2_paged_search", r"""
WITH dtok AS (SELECT id, unnest(t) AS token FROM (SELECT id, %(tokens)s AS t FROM {facts})), qtok AS (SELECT query_id AS id, unnest(t) AS token, unnest(range(len(t))) AS place FROM (SELECT query_id, %(tokens)s AS t FROM {asked})),
vocab AS (SELECT token FROM dtok UNION SELECT token FROM qtok), stems AS (%(stems)s),
terms AS (SELECT token, 0 AS kind, sha256(token) AS hash FROM vocab UNION ALL SELECT token, 1, sha256('stem:' || stem) FROM stems WHERE strlen(stem) >= 2),
post AS (SELECT DISTINCT id, hash FROM dtok JOIN terms USING (token)),
trap AS (SELECT id AS query_id, hash, min(place * 2 + kind) AS pos FROM qtok JOIN terms USING (token) GROUP BY 1, 2),
chunks AS (SELECT query_id, hash, (row_number() OVER (PARTITION BY query_id ORDER BY pos, hash) - 1) // %(chunk)d AS chunk FROM trap),
entries AS (SELECT query_id, id, chunk, (row_number() OVER (PARTITION BY query_id, chunk ORDER BY id, hash) - 1) // %(page)d AS page FROM post JOIN chunks USING (hash)),
seen AS (SELECT query_id, id, min(CASE WHEN page = 0 THEN -1 ELSE chunk * 1000000 + page END) AS spot FROM entries GROUP BY 1, 2),
pages AS (SELECT query_id, spot, coalesce(sum(count(*)) OVER (PARTITION BY query_id ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  row_number() OVER (PARTITION BY query_id ORDER BY spot) - max(CASE WHEN spot < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS n FROM seen GROUP BY query_id, spot)
SELECT s.query_id, s.id, CAST(CASE WHEN spot < 0 THEN 0 ELSE n END AS BIGINT) AS seen FROM seen s JOIN pages p USING (query_id, spot) WHERE spot < 0 OR before < %(most)d""" % {"tokens": _TOKENS, "stems": stems_sql("vocab"), "chunk": CHUNK, "page": PAGE, "most": MOST})
def paged_search(role):
    trapdoors = materialize(R.trapdoors(role("asked").select("query_id", "text"), id_col="query_id"), "trapdoors")
    return R.paged_search(R.blind_postings(role("fact_rows").select("id", "text"), among=trapdoors.select("hash")), trapdoors, chunk=CHUNK, page=PAGE, most=MOST)


@query("J3_broadened", POOL_SQL + """, recent AS (SELECT id, owner, row_number() OVER (PARTITION BY owner ORDER BY created_at DESC, id) AS r FROM {facts} WHERE decay_score >= 0.3)
SELECT query_id, id, min(origin) AS origin FROM (SELECT query_id, id, 0 AS origin FROM pool UNION ALL SELECT a.query_id, r.id, 1 AS origin FROM {asked} a JOIN recent r ON r.owner = a.query_id % 7 WHERE r.r <= 1000) GROUP BY 1, 2""")
def broadened(role):
    # The pool, and the newest active facts of the one who asks: an owner's queries meet its facts only.
    newest = F.row_number().over(W.partitionBy("owner").orderBy(F.desc("created_at"), "id"))
    recent = role("fact_rows").filter("decay_score >= 0.3").withColumn("r", newest).filter("r <= 1000").select("owner", "id")
    own = role("asked").select("query_id", (F.col("query_id") % 7).alias("owner")).join(recent, "owner").select("query_id", "id")
    return R.union_first_seen(pool(role).select("query_id", "id"), own, ["query_id", "id"])


@query("J10_overlap_ratio", fr"""
WITH dtok AS (SELECT conv_id * 1000 + turn AS id, unnest({_TOKENS}) AS token FROM {{conversations}}), vocab AS (SELECT DISTINCT token FROM dtok), stems AS ({stems_sql("vocab")}),
terms AS (SELECT token, sha256(token) AS hash FROM vocab UNION ALL SELECT token, sha256('stem:' || stem) FROM stems WHERE strlen(stem) >= 2),
post AS (SELECT DISTINCT id, hash FROM dtok JOIN terms USING (token)), sizes AS (SELECT id, count(*) AS size FROM post GROUP BY 1),
shared AS (SELECT n.id AS new_id, o.id AS old_id, count(*) AS shared FROM post n JOIN post o ON n.hash = o.hash AND o.id < n.id GROUP BY 1, 2),
ratios AS (SELECT new_id, old_id, shared, shared / greatest(size, 1) AS ratio FROM shared JOIN sizes ON id = old_id),
best AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY ratio DESC, old_id) AS rank FROM ratios WHERE ratio > 0.6)
SELECT new_id, old_id, shared, round(ratio, 6) AS ratio, CAST(rank AS INTEGER) AS rank FROM best WHERE rank <= 5""")
def overlap_ratio(role):
    rows = role("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return R.overlap_ratio_of_texts(rows).withColumn("ratio", F.round("ratio", 6))


@query("H1_bm25_core", CORE_SQL + "SELECT query_id, id, round(bm25, 6) AS bm25 FROM scored")
def bm25_core(role):
    return ranked_by_words(role).withColumn("bm25", F.round("bm25", 6))


@query("H2_bm25_okapi", OKAPI_SQL + "SELECT query_id, id, round(bm25, 6) AS bm25 FROM scored")
def bm25_okapi(role):
    return ranked_by_words(role, "okapi").withColumn("bm25", F.round("bm25", 6))


@query("H3_bm25_quick", r"""
WITH pairs AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM {conversations}),
toks AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) > 0) AS d, list_filter(string_split_regex(lower(q), '[^\p{L}\p{N}]+'), lambda x: length(x) > 0) AS qt FROM pairs WHERE q IS NOT NULL)
SELECT conv_id, turn, round(coalesce(list_sum(list_transform(qt, lambda q: len(list_filter(d, lambda t: t = q)) * 2.2 / (len(list_filter(d, lambda t: t = q)) + 1.2))), 0), 6) AS score FROM toks""")
def bm25_quick(role):
    following = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    pairs = role("conversations").withColumn("q", following).filter("q is not null")
    return pairs.select("conv_id", "turn", F.round(R.bm25_quick(T.plain_tokens(F.col("text")), T.plain_tokens(F.col("q"))), 6).alias("score"))


@query("H4_cosine", CORE_SQL + COSINE_SQL + "SELECT query_id, id, round(cosine, 6) AS cosine FROM cos")
def cosine(role):
    return R.with_cosine(pool(role).select("query_id", "id"), role("asked"), _vectors(role)).withColumn("cosine", F.round("cosine", 6))


@query("H7_fused_rerank", CORE_SQL + COSINE_SQL + fused_sql(False))
def fused(role):
    return _shown(R.top_k(R.fuse(scored(role)), KEEP))


@query("H8_source_weighted_rerank", CORE_SQL + COSINE_SQL + fused_sql(True))
def fused_by_source(role):
    return _shown(R.top_k(R.fuse(scored(role), weigh_sources=True), KEEP))


@query("H5_weighted_rrf", OKAPI_SQL + COSINE_SQL + """,
lists AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 12) DESC, id) AS b, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 12) DESC, id) AS c FROM cos),
fused AS (SELECT query_id, id, 0.6 / (60 + b) + 0.4 / (60 + c) AS score FROM lists),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS k FROM fused)
SELECT query_id, id, round(score, 6) AS score, k AS rank FROM best WHERE k <= 8""")
def weighted_rrf(role):
    rows = scored(role, "okapi")
    lists = [R.position_rank(rows, c, "position", "id").select("query_id", "id", "position") for c in ("bm25", "cosine")]
    fused_ = R.reciprocal_rank_fusion(lists, [0.6, 0.4])
    return R.top_k(fused_, KEEP).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# The expressions of a query's intent, and the weights of the four signals for each.
TEMPORAL = r"(?i)\b(yesterday|today|last\s+week|last\s+month|recently|recent|latest|ago|when|this\s+week|this\s+month|earlier|before|after|since|during|tonight|morning|afternoon)\b"
FACTUAL = r"(?i)^(what|who|where|which|how\s+many|how\s+much|is\s+|are\s+|does\s+|do\s+|did\s+|was\s+|were\s+)\b"
INTENT_WEIGHTS = {"factual": (0.40, 0.20, 0.25, 0.15), "temporal": (0.15, 0.20, 0.20, 0.45), "semantic": (0.20, 0.35, 0.25, 0.20)}
SIGNALS = ("bm25", "cosine", "importance", "recency")

_INTENT_SQL = f"CASE WHEN regexp_matches(text, '{TEMPORAL}') THEN 'temporal' WHEN regexp_matches(text, '{FACTUAL}') AND length(text) < 80 THEN 'factual' ELSE 'semantic' END"


def _weight_sql(signal: str) -> str:
    at = SIGNALS.index(signal)
    return "(CASE intent " + " ".join(f"WHEN '{kind}' THEN {weights[at]}" for kind, weights in INTENT_WEIGHTS.items()) + " END)"



def intent(text):
    temporal, factual = (text.rlike(T.ascii_pattern(p)) for p in (TEMPORAL, FACTUAL))
    return F.when(temporal, "temporal").when(factual & (F.length(text) < 80), "factual").otherwise("semantic")


@query("H10_query_intent", f"""WITH texts AS (SELECT item_id AS id, text FROM {{benchmark}} UNION ALL SELECT 100000 + conv_id * 1000 + turn, text FROM {{conversations}} UNION ALL SELECT 0 - 1 - page_id, 'When was page ' || page_id || ' saved?' FROM {{pages}} UNION ALL SELECT 0 - 100001 - page_id, 'Which page is ' || page_id || '?' FROM {{pages}})
SELECT id, {_INTENT_SQL} AS intent FROM texts""")
def query_intent(role):
    texts = role("benchmark").select(F.col("item_id").alias("id"), "text")
    texts = texts.unionByName(role("conversations").select((100000 + F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"))
    for base, before, after in ((-1, "When was page ", " saved?"), (-100001, "Which page is ", "?")):
        texts = texts.unionByName(role("pages").select((F.lit(base) - F.col("page_id")).alias("id"), F.concat(F.lit(before), F.col("page_id").cast("string"), F.lit(after)).alias("text")))
    return texts.select("id", intent(F.col("text")).alias("intent"))


_NOW = 1_800_000_000
_FOUR_SQL = OKAPI_SQL + COSINE_SQL + f""",
kinds AS (SELECT query_id, {_INTENT_SQL} AS intent FROM {{asked}}),
recent AS (SELECT c.*, k.intent, CASE WHEN c.created_at IS NULL THEN 0.5 ELSE 1 / (1 + ({_NOW} - c.created_at) / 3600.0 / 168) END AS recency FROM cos c JOIN kinds k USING (query_id)),
lists AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 12) DESC, id) AS pb,
    CASE WHEN fe IS NOT NULL THEN row_number() OVER (PARTITION BY query_id, fe IS NULL ORDER BY round(cosine, 12) DESC, id) END AS pc,
    row_number() OVER (PARTITION BY query_id ORDER BY round(importance, 12) DESC, id) AS pi, row_number() OVER (PARTITION BY query_id ORDER BY round(recency, 12) DESC, id) AS pr FROM recent),
fused AS (SELECT query_id, id, fe,
    {_weight_sql("bm25")} / (60 + pb) + coalesce({_weight_sql("cosine")} / (60 + pc), 0) + {_weight_sql("importance")} / (60 + pi) + {_weight_sql("recency")} / (60 + pr) AS score FROM lists),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS k FROM fused)
"""


def four_signals(role) -> DataFrame:
    facts, asked = role("facts"), role("asked")
    rows = scored(role, "okapi").join(asked.select("query_id", intent(F.col("text")).alias("intent")), "query_id").join(_vectors(role).select("id", F.lit(True).alias("embedded")), "id", "left").withColumn("embedded", F.coalesce("embedded", F.lit(False)))
    rows = rows.withColumn("recency", F.when(F.col("created_at").isNull(), 0.5).otherwise(1 / (1 + (F.lit(_NOW) - F.col("created_at")) / 3600.0 / 168)))
    score = F.lit(0.0)
    for i, signal in enumerate(SIGNALS):
        per = W.partitionBy("query_id", "embedded") if signal == "cosine" else W.partitionBy("query_id")
        place = F.row_number().over(per.orderBy(F.desc(F.round(signal, 12)), "id"))
        weight = F.when(F.col("intent") == "factual", INTENT_WEIGHTS["factual"][i]).when(F.col("intent") == "temporal", INTENT_WEIGHTS["temporal"][i]).otherwise(INTENT_WEIGHTS["semantic"][i])
        part = weight / (R.RRF_K + place)
        score = score + (F.when(F.col("embedded"), part).otherwise(0.0) if signal == "cosine" else part)
    return rows.withColumn("score", score)


@query("H9_four_signal_rerank", _FOUR_SQL + "SELECT query_id, id, round(score, 6) AS score, k AS rank FROM best WHERE k <= 20")
def four_signal(role):
    return R.top_k(four_signals(role), 20).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_MMR_SQL = "WITH RECURSIVE " + _FOUR_SQL.strip().removeprefix("WITH ") + """,
ranked AS (SELECT query_id, id, CAST(k - 1 AS DOUBLE) AS pos, CAST(fe AS DOUBLE[]) AS v, count(*) OVER (PARTITION BY query_id) AS m FROM best WHERE k <= 100),
walk AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS ids, CAST([] AS DOUBLE[][]) AS vs FROM ranked
  UNION ALL SELECT query_id, n + 1, list_append(any_value(ids), first(id ORDER BY gain DESC, pos)), list_append(any_value(vs), first(v ORDER BY gain DESC, pos)) FROM (
    SELECT w.query_id, w.n, w.ids, w.vs, r.id, r.pos, r.v, 0.7 * (1 - r.pos / r.m) - 0.3 * coalesce(list_max(list_transform(w.vs, lambda p: CASE WHEN p IS NULL OR r.v IS NULL OR len(p) <> len(r.v) THEN 0.0
      ELSE greatest(0.0, list_dot_product(p, r.v) / (sqrt(list_dot_product(p, p)) * sqrt(list_dot_product(r.v, r.v)))) END)), 0.0) AS gain
    FROM walk w JOIN ranked r ON r.query_id = w.query_id AND NOT list_contains(w.ids, r.id) WHERE w.n < 8) GROUP BY query_id, n)
SELECT query_id, ids[n] AS id, n AS pick FROM walk WHERE n >= 1"""


@query("H11_mmr", _MMR_SQL)
def mmr(role):
    ranked = R.top_k(four_signals(role), 100).withColumn("position", F.col("rank")).join(role("facts").select("id", "embedding"), "id")
    return R.mmr(ranked.select("query_id", "id", "position", "embedding"))


@query("H12_legacy_weighted_sum", OKAPI_SQL + COSINE_SQL + """,
scaled AS (SELECT *, CASE WHEN max(bm25) OVER q = min(bm25) OVER q THEN 0.5 ELSE (bm25 - min(bm25) OVER q) / (max(bm25) OVER q - min(bm25) OVER q) END AS nb FROM cos WINDOW q AS (PARTITION BY query_id)),
fused AS (SELECT *, 0.4 * cosine + 0.4 * nb + 0.2 * CASE WHEN coalesce(decay_score, 0) = 0 THEN 0.5 ELSE decay_score END AS score FROM scaled),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS k FROM fused)
SELECT query_id, id, round(score, 6) AS score, k AS rank FROM best WHERE k <= 8""")
def legacy_sum(role):
    rows = scored(role, "okapi")
    decay = F.when(F.coalesce("decay_score", F.lit(0.0)) == 0, 0.5).otherwise(F.col("decay_score"))
    rows = rows.withColumn("nb", R.min_max(F.col("bm25"), W.partitionBy("query_id"))).withColumn("score", 0.4 * F.col("cosine") + 0.4 * F.col("nb") + 0.2 * decay)
    return R.top_k(rows, KEEP).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("H13_min_max_signals", """WITH n AS (SELECT label, vec_id, CASE WHEN max(embedding[1]) OVER w = min(embedding[1]) OVER w THEN 0.5 ELSE (CAST(embedding[1] AS DOUBLE) - min(embedding[1]) OVER w) / (CAST(max(embedding[1]) OVER w AS DOUBLE) - min(embedding[1]) OVER w) END AS a,
 CASE WHEN max(embedding[2]) OVER w = min(embedding[2]) OVER w THEN 0.5 ELSE (CAST(embedding[2] AS DOUBLE) - min(embedding[2]) OVER w) / (CAST(max(embedding[2]) OVER w AS DOUBLE) - min(embedding[2]) OVER w) END AS b FROM {embeddings} WINDOW w AS (PARTITION BY label))
SELECT label, vec_id, round(0.7 * coalesce(a, 0) + 0.3 * coalesce(b, 0), 5) AS score FROM n""")
def min_max_signals(role):
    per = W.partitionBy("label")
    rows = role("embeddings").select("label", "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    a, b = R.min_max(F.col("x"), per), R.min_max(F.col("y"), per)
    return rows.select("label", "vec_id", F.round(0.7 * F.coalesce(a, F.lit(0.0)) + 0.3 * F.coalesce(b, F.lit(0.0)), 5).alias("score"))


@query("H6_expansion_merge", r"""
WITH words AS (SELECT item_id AS query_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: strlen(x) >= 2) AS t FROM {benchmark}),
halves AS (SELECT query_id, 0 AS part, unnest(t[1:len(t) // 2]) AS token FROM words UNION ALL SELECT query_id, 1 AS part, unnest(t[len(t) // 2 + 1:]) FROM words),
dtok AS (SELECT DISTINCT doc_id AS id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: strlen(x) >= 2)) AS token FROM {documents}),
hits AS (SELECT h.query_id, h.part, d.id, count(*) AS n FROM (SELECT DISTINCT * FROM halves) h JOIN dtok d USING (token) GROUP BY 1, 2, 3),
lists AS (SELECT *, row_number() OVER (PARTITION BY query_id, part ORDER BY n DESC, id) AS position FROM hits),
fused AS (SELECT query_id, id, sum(1.0 / (60 + position)) AS score FROM lists WHERE position <= 50 GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS k FROM fused)
SELECT query_id, id, round(score, 6) AS score, k AS rank FROM best WHERE k <= 8""")
def expansion_merge(role):
    # The two halves of a query stand for two reformulations of it.
    words = role("benchmark").select(F.col("item_id").alias("query_id"), T.tokens(F.col("text")).alias("t"))
    half = F.floor(F.size("t") / 2).cast("int")
    parts = F.explode(F.array(F.struct(F.lit(0).alias("part"), F.slice("t", F.lit(1), half).alias("w")), F.struct(F.lit(1).alias("part"), F.slice("t", half + 1, F.size("t")).alias("w")))).alias("p")
    asked = words.select("query_id", parts).select("query_id", "p.part", F.explode("p.w").alias("token"))
    lists = R.best_by_shared_words(role("documents").select(F.col("doc_id").alias("id"), "text"), asked, ["query_id", "part"], most=50)
    merged = lists.groupBy("query_id", "id").agg(F.sum(1.0 / (R.RRF_K + F.col("position"))).alias("score"))
    return R.top_k(merged, KEEP).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("F12_relevance_gate", CORE_SQL + COSINE_SQL + "SELECT query_id, max(cosine) >= 0.15 AS relevant FROM cos GROUP BY 1")
def relevance_gate(role):
    rows = R.with_cosine(pool(role).select("query_id", "id"), role("asked"), _vectors(role))
    return rows.groupBy("query_id").agg((F.max("cosine") >= 0.15).alias("relevant"))


@query("J4_cosine_pairs", """
WITH units AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM {embeddings})
SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 6) AS cosine FROM units a JOIN units b ON a.vec_id < b.vec_id WHERE round(list_dot_product(a.v, b.v), 12) >= 0.35""")
def all_cosine_pairs(role):
    """All pairs with a cosine of at least 0.35, at which buckets don't narrow the search, so each is computed."""
    return V.cosine_pairs(role("embeddings"), 0.35, id_col="vec_id", vector_col="embedding").withColumn("cosine", F.round("cosine", 6))


#: The secret of the registered queries' planes; a deployment derives its own.
LSH_SECRET = b"registered query planes"
LSH_LEAST, LSH_DIMS = 0.9, 64


@query("J4_lsh_buckets", f"""
WITH RECURSIVE {L.planes_sql(LSH_SECRET, LSH_DIMS).replace("{", "{{").replace("}", "}}")},
rows AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM {{embeddings}}
  UNION ALL SELECT vec_id + 10000000, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: CASE WHEN (i - 1 + vec_id) % 32 = 0 THEN 0.0 ELSE x END) FROM {{embeddings}}),
one AS (SELECT min(id) AS id, v FROM rows WHERE len(v) = {LSH_DIMS} GROUP BY v HAVING list_dot_product(v, v) > 0),
signed AS (SELECT id, t, string_agg(CASE WHEN list_dot_product(v, weights) >= 0 THEN '1' ELSE '0' END, '' ORDER BY b) AS bucket FROM one, planes GROUP BY id, t),
met AS (SELECT x.id AS a, y.id AS b, count(*) AS n_tables FROM signed x JOIN signed y ON x.t = y.t AND x.bucket = y.bucket AND x.id < y.id GROUP BY 1, 2),
units AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS norm FROM one),
pairs AS (SELECT a, b, n_tables, list_dot_product(x.v, y.v) / (x.norm * y.norm) AS cosine FROM met JOIN units x ON x.id = a JOIN units y ON y.id = b),
kept AS (SELECT * FROM pairs WHERE round(cosine, 12) >= {LSH_LEAST}),
wanted AS (SELECT DISTINCT least(x.id, y.id), greatest(x.id, y.id) FROM units x JOIN units y ON x.id <> y.id AND x.id % 100 = 0 AND round(list_dot_product(x.v, y.v) / (x.norm * y.norm), 12) >= {LSH_LEAST}),
measured AS (SELECT (SELECT count(*) FROM kept WHERE a % 100 = 0 OR b % 100 = 0) / greatest(1, (SELECT count(*) FROM wanted)) AS recall)
SELECT a, b, n_tables, round(cosine, 6) AS cosine, round(recall, 6) AS recall FROM kept, measured""")
def lsh_buckets(role):
    """Pairs of vectors that share a bucket in one of the tables, verified; of each vector a copy with two entries cleared is searched too.

    recall: which share of all pairs that an id divisible by 100 has, by comparing those with every vector, the buckets found.
    """
    own = role("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    cleared = F.transform("embedding", lambda x, i: F.when((i + F.col("vec_id")) % 32 == 0, F.lit(0.0).cast("float")).otherwise(x))
    vectors = own.unionByName(role("embeddings").select((F.col("vec_id") + 10_000_000).alias("id"), cleared.alias("embedding")))
    pairs = materialize(L.near_pairs(vectors, LSH_LEAST, LSH_SECRET, LSH_DIMS), "pairs")
    one = vectors.groupBy("embedding").agg(F.min("id").alias("id"))
    hits = V.cosine_hits(one.filter("id % 100 = 0"), one, LSH_LEAST)
    wanted = hits.select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b")).distinct().agg(F.count("*").alias("n"))
    found = pairs.filter("a % 100 = 0 OR b % 100 = 0").agg(F.count("*").alias("n"))
    recall = found.select(F.col("n").alias("found")).crossJoin(wanted).select(F.round(F.col("found") / F.greatest(F.col("n"), F.lit(1)), 6).alias("recall"))  # two numbers
    return pairs.crossJoin(F.broadcast(recall)).select("a", "b", "n_tables", F.round("cosine", 6).alias("cosine"), "recall")


# Pools of the two tiers.
TIER_POOLS = {"free": 100, "pro": 250}


@query("K2_pool_sizes", """SELECT region, facts, least(greatest(facts * 3, 400), 5000) AS pool, CAST(CASE WHEN facts < 2000 THEN 2000 WHEN facts < 10000 THEN greatest(2000, least(4000, floor(facts * 0.35))) WHEN facts < 100000 THEN least(10000, 3000 + floor(log10(facts) * 500)) ELSE 10000 END AS BIGINT) AS pool_by_size, CASE WHEN region % 2 = 0 THEN 250 ELSE 100 END AS pool_by_tier
FROM (SELECT n_regionkey AS region, CAST(n_nationkey AS BIGINT) * n_nationkey * 300 + 100 AS facts FROM {nation})""")
def pool_sizes(role):
    """How many candidates a search takes, by each of three rules: three times the facts within bounds, by steps of the facts' number, by tier."""
    n = F.col("facts")
    rows = role("nation").select(F.col("n_regionkey").alias("region"), (F.col("n_nationkey").cast("long") * F.col("n_nationkey") * 300 + 100).alias("facts"))
    stepped = F.when(n < 2000, F.lit(2000)).when(n < 10_000, F.greatest(F.lit(2000), F.least(F.lit(4000), F.floor(n * 0.35)))).when(n < 100_000, F.least(F.lit(10_000), 3000 + F.floor(F.log10(n) * 500))).otherwise(10_000)
    tier = F.when(F.col("region") % 2 == 0, TIER_POOLS["pro"]).otherwise(TIER_POOLS["free"])
    return rows.select("region", "facts", F.least(F.greatest(n * 3, F.lit(400)), F.lit(5000)).alias("pool"), stepped.cast("long").alias("pool_by_size"), tier.alias("pool_by_tier"))
