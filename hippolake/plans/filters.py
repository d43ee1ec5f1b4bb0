"""Queries: predicates, validation and small text functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hippolake.functions import text as T
from hippolake.functions.stem import stems_sql
from hippolake.operators import retrieval as R
from hippolake.plans.catalog import query

# Phrases of pin intents, by kind, in the order in which they are tried.
PIN_PHRASES = {
    "tier_swap_to_hard": ("make that a hard pin", "make this a hard pin", "promote that pin", "upgrade that pin to hard"),
    "tier_swap_to_soft": ("downgrade that pin to soft", "make that a soft pin", "make this a soft pin"),
    "hard": ("always remember i", "never forget i", "this is a permanent rule", "permanent rule", "rule of thumb:", "rule of thumb,"),
    "unpin": ("unpin that", "unpin this", "no longer pin", "remove pin from", "remove the pin from", "i changed my mind about"),
    "soft": ("remember this", "pin this", "remember that i", "save that for later", "don't forget i", "dont forget i", "pin that"),
}
# Expressions of requests about setting a memory product up, and of instructions about how it shows memories.
META_PATTERNS = (
    r"\bset(\s+)?up\b.*\b(memory|vault|plugin|product)\b",
    r"\b(install|configure)\b.*\b(memory|vault|plugin)\b",
    r"\b(the\s+)?(memory|vault)\s+plugin\b",
    r"\bi\s+want\s+(encrypted\s+)?memory\s+across\s+my\s+(ai|agents|tools)\b",
)
SURFACING_PATTERNS = (
    r"\bsurfac(?:e|ed|es|ing)\b.*\b(?:every\s+time|each\s+time|always|whenever|again)\b",
    r"\b(?:every\s+time|each\s+time|always|whenever)\b.*\bsurfac(?:e|ed|es|ing)\b",
    r"\bpin(?:ned|ning)?\s+(?:it|this|that|these|those)\b",
    r"\bkeep\b.*\b(?:surfac|pinned|at\s+the\s+top|top\s+of|always\s+visible)\b",
    r"\bsurface\s+(?:it|this|that|them)\s+(?:every\s+time|each\s+time|always)\b",
)
# Expressions of the extraction that needs no model, with the type and importance of what they find.
HEURISTICS = (
    (r"(?i)(?:I|my)\s+(?:prefer|like|want|need|use|enjoy|love|hate)\s+(.+)", "preference", 7),
    (r"(?i)(?:my name is|I'm called|call me)\s+(.+)", "claim", 8),
    (r"(?i)(?:remember|don't forget|keep in mind)\s+(?:that\s+)?(.+)", "claim", 7),
    (r"(?i)(?:I chose|I decided|we decided|decision:)\s+(.+)", "claim", 7),
    (r"(?i)(?:I work|I'm a|my job|my role)\s+(.+)", "claim", 7),
)
# Older type names and what they became.
TYPE_MAP = {"fact": "claim", "decision": "claim", "episodic": "episode", "goal": "commitment", "context": "claim", "rule": "directive", "preference": "preference", "summary": "summary"}


def pin_intent(text):
    """struct<kind, phrase> of the first phrase in order, null without one."""
    low = F.lower(text)
    out = F.lit(None).cast("struct<kind:string,phrase:string>")
    for kind, phrases in reversed(PIN_PHRASES.items()):
        for phrase in reversed(phrases):
            out = F.when(F.contains(low, F.lit(phrase)), F.struct(F.lit(kind).alias("kind"), F.lit(phrase).alias("phrase"))).otherwise(out)
    return out


def matches_any(text, patterns: tuple[str, ...]):
    low = F.lower(F.trim(text))
    found = F.lit(False)
    for p in patterns:
        found = found | low.rlike(p)
    return found


#: Sentences made of the tables' rows, so that phrases occur in them.
_SAID_SQL = """SELECT p_partkey AS id, CASE p_partkey % 12 WHEN 0 THEN 'Please remember this ' WHEN 1 THEN 'Always remember I like the ' WHEN 2 THEN 'Make that a hard pin: ' WHEN 3 THEN 'Unpin that ' WHEN 4 THEN 'I want memory across my AI ' WHEN 5 THEN 'Set up the vault for '
 WHEN 6 THEN 'It should surface every time: ' WHEN 7 THEN 'I prefer the ' WHEN 8 THEN 'My name is ' WHEN 9 THEN 'We decided on the ' WHEN 10 THEN 'Keep it pinned, ' ELSE 'Only a ' END || p_name || ' of ' || p_brand AS text FROM {part}"""


def _said(role):
    starts = ("Please remember this ", "Always remember I like the ", "Make that a hard pin: ", "Unpin that ", "I want memory across my AI ", "Set up the vault for ", "It should surface every time: ", "I prefer the ", "My name is ", "We decided on the ", "Keep it pinned, ", "Only a ")
    start = F.get(F.array(*map(F.lit, starts)), (F.col("p_partkey") % 12).cast("int"))
    return role("part").select(F.col("p_partkey").alias("id"), F.concat(start, "p_name", F.lit(" of "), "p_brand").alias("text"))


def _like_sql(patterns) -> str:
    return " OR ".join(f"regexp_matches(lower(trim(text)), '{p}')" for p in patterns)


_PIN_SQL = "CASE " + " ".join(f"WHEN contains(lower(text), '{phrase.replace(chr(39), chr(39) * 2)}') THEN '{kind}|{phrase.replace(chr(39), chr(39) * 2)}'" for kind, phrases in PIN_PHRASES.items() for phrase in phrases) + " END"


@query("C35_pin_intent", f"SELECT id, split_part({_PIN_SQL}, '|', 1) AS kind, split_part({_PIN_SQL}, '|', 2) AS phrase FROM ({_SAID_SQL}) WHERE {_PIN_SQL} IS NOT NULL")
def pin_intents(role):
    return _said(role).withColumn("pin", pin_intent(F.col("text"))).filter("pin is not null").select("id", "pin.kind", "pin.phrase")


@query("F9_product_meta", f"SELECT id, {_like_sql(META_PATTERNS)} AS meta FROM ({_SAID_SQL})")
def product_meta(role):
    return _said(role).select("id", matches_any(F.col("text"), META_PATTERNS).alias("meta"))


@query("F10_surfacing_instruction", f"SELECT id, {_like_sql(SURFACING_PATTERNS)} AS instruction FROM ({_SAID_SQL})")
def surfacing_instruction(role):
    return _said(role).select("id", matches_any(F.col("text"), SURFACING_PATTERNS).alias("instruction"))


_HEUR_SQL = " UNION ALL ".join(f"SELECT id, {i} AS rule, '{kind}' AS type, {importance} AS importance, unnest(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}', 1)) AS found FROM ({_SAID_SQL})" for i, (p, kind, importance) in enumerate(HEURISTICS))


@query("C29_heuristic_extraction", f"SELECT id, rule, type, importance, substr(rtrim(trim(found), '.'), 1, 512) AS text FROM ({_HEUR_SQL}) WHERE length(rtrim(trim(found), '.')) > 10")
def heuristic_extraction(role):
    said = _said(role)
    arms = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(kind).alias("type"), F.lit(importance).alias("importance"), F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("found")) for i, (p, kind, importance) in enumerate(HEURISTICS)])
    rows = said.select("id", F.inline(arms)).select("id", "rule", "type", "importance", F.explode("found").alias("found"))
    text = F.rtrim(F.trim("found"), F.lit("."))
    return rows.filter(F.length(text) > 10).select("id", "rule", "type", "importance", F.substring(text, 1, 512).alias("text"))


#: Beginnings of wishes, and what they are about when they are about this engine itself.
WISHES, OWN_NAMES = ("i want", "i'll always"), ("memory", "recall tool")


def _any_of_sql(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join("contains(lower(text), '%s')" % w.replace("'", "''") for w in words) + ")"


@query("F20_self_directive", f"SELECT id, {_any_of_sql(WISHES)} AND {_any_of_sql(OWN_NAMES)} AS directive FROM (" + _SAID_SQL + ")")
def self_directive(role):
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("text"), w))
    return _said(role).select("id", (any_of(WISHES) & any_of(OWN_NAMES)).alias("directive"))


@query("F1_active_decay", "SELECT id, user_id FROM {stored} WHERE is_active AND decay_score >= 0.3")
def active_decay(role):
    return role("stored").filter("is_active and decay_score >= 0.3").select("id", "user_id")


@query("F2_derived_activity", "SELECT event_id, points / 100.0 >= 0.3 AS is_active FROM {log}")
def derived_activity(role):
    return role("log").select("event_id", (F.col("points") / 100.0 >= 0.3).alias("is_active"))


_HEX_SQL = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN sha256(text) WHEN 1 THEN upper(sha256(text)) WHEN 2 THEN substr(sha256(text), 1, 63) ELSE sha256(text) || 'g' END AS h FROM {documents}"


def _hex(role):
    h = F.sha2("text", 256)
    return role("documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, h).when(F.col("doc_id") % 4 == 1, F.upper(h)).when(F.col("doc_id") % 4 == 2, F.substring(h, 1, 63)).otherwise(F.concat(h, F.lit("g"))).alias("h"))


@query("F3_hex_validation", f"SELECT doc_id, regexp_full_match(h, '[0-9a-fA-F]{{64}}') AS stored_ok, regexp_full_match(h, '[a-f0-9]{{64}}') AS request_ok FROM ({_HEX_SQL})".replace("{{64}}", "{64}"))
def hex_validation(role):
    return _hex(role).select("doc_id", F.col("h").rlike(r"^[0-9a-fA-F]{64}$").alias("stored_ok"), F.col("h").rlike(r"^[a-f0-9]{64}$").alias("request_ok"))


_BLOB_SQL = "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '0x' WHEN 3 THEN '0X0000' WHEN 4 THEN '0000' ELSE '0x00a1' END AS blob FROM {part}"


@query("F4_stub_blob", f"SELECT id, blob IS NULL OR regexp_full_match(blob, '(0[xX])?0*') AS stub FROM ({_BLOB_SQL})")
def stub_blob(role):
    blob = F.get(F.array(F.lit(None).cast("string"), F.lit(""), F.lit("0x"), F.lit("0X0000"), F.lit("0000"), F.lit("0x00a1")), (F.col("p_partkey") % 6).cast("int"))
    return role("part").select(F.col("p_partkey").alias("id"), (blob.isNull() | blob.rlike(r"^(0[xX])?0*$")).alias("stub"))


@query("F5_infra_claims", "SELECT event_id, event_type FROM {events} WHERE event_type NOT IN ('error', 'signup')")
def infra_claims(role):
    return role("events").filter(~F.col("event_type").isin("error", "signup")).select("event_id", "event_type")


@query("F6_importance_filter", "SELECT event_id, coalesce(CASE WHEN event_id % 8 <> 0 THEN CAST(floor(value / 10) AS BIGINT) END, 5) AS importance FROM {events} WHERE coalesce(CASE WHEN event_id % 8 <> 0 THEN CAST(floor(value / 10) AS BIGINT) END, 5) >= 4")
def importance_filter(role):
    importance = F.coalesce(F.when(F.col("event_id") % 8 != 0, F.floor(F.col("value") / 10)), F.lit(5).cast("long"))
    return role("events").select("event_id", importance.alias("importance")).filter("importance >= 4")


@query("F7_fact_validation", """SELECT id, CASE WHEN kind IN ('claim', 'preference', 'directive', 'episode') THEN kind ELSE 'claim' END AS type, source, importance, action FROM (
 SELECT conv_id * 1000 + turn AS id, CASE turn % 5 WHEN 0 THEN 'preference' WHEN 1 THEN 'summary' WHEN 2 THEN 'nonsense' ELSE 'claim' END AS kind, role AS source, length(text) % 10 + 1 AS importance, CASE WHEN turn % 7 = 6 THEN 'DELETE' ELSE 'ADD' END AS action, text FROM {conversations})
 WHERE length(trim(text)) >= 5 AND NOT (kind = 'summary' AND source = 'user') AND (action = 'DELETE' OR importance >= 6)""")
def fact_validation(role):
    kind = F.when(F.col("turn") % 5 == 0, "preference").when(F.col("turn") % 5 == 1, "summary").when(F.col("turn") % 5 == 2, "nonsense").otherwise("claim")
    rows = role("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), kind.alias("kind"), F.col("role").alias("source"), (F.length("text") % 10 + 1).cast("long").alias("importance"), F.when(F.col("turn") % 7 == 6, "DELETE").otherwise("ADD").alias("action"), "text")
    kept = rows.filter((F.length(F.trim("text")) >= 5) & ~((F.col("kind") == "summary") & (F.col("source") == "user")) & ((F.col("action") == "DELETE") | (F.col("importance") >= 6)))
    known = F.when(F.col("kind").isin("claim", "preference", "directive", "episode"), F.col("kind")).otherwise("claim")
    return kept.select("id", known.alias("type"), "source", "importance", "action")


@query("F8_import_validation", "SELECT doc_id AS id, substr(trim(text), 1, 512) AS text, CASE WHEN i <= 1 THEN greatest(1, CAST(round(i * 10) AS BIGINT)) ELSE least(CAST(i AS BIGINT), 10) END AS importance FROM (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN doc_id % 11 / 10.0 ELSE doc_id % 14 + 2 END AS i FROM {documents}) WHERE length(trim(text)) >= 3")
def import_validation(role):
    i = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 11 / 10.0).otherwise((F.col("doc_id") % 14 + 2).cast("double"))
    importance = F.when(i <= 1, F.greatest(F.lit(1), F.round(i * 10).cast("long"))).otherwise(F.least(i.cast("long"), F.lit(10)))
    return role("documents").filter(F.length(F.trim("text")) >= 3).select(F.col("doc_id").alias("id"), F.substring(F.trim("text"), 1, 512).alias("text"), importance.alias("importance"))


@query("F11_provenance", r"""
WITH u AS (SELECT conv_id, string_agg(lower(text), ' ' ORDER BY turn) AS said FROM {conversations} WHERE role = 'user' GROUP BY 1),
a AS (SELECT c.conv_id, c.turn, coalesce(u.said, '') AS said, list_filter(string_split_regex(lower(c.text), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 4) AS words, length(c.text) % 10 + 1 AS importance FROM {conversations} c LEFT JOIN u USING (conv_id) WHERE c.role = 'assistant'),
r AS (SELECT *, CASE WHEN len(words) = 0 THEN 1.0 ELSE len(list_filter(words, lambda w: contains(said, w))) / len(words) END AS ratio FROM a)
SELECT conv_id, turn, round(ratio, 6) AS ratio, CASE WHEN ratio < 0.3 THEN 'assistant' ELSE 'user' END AS source, CASE WHEN ratio < 0.3 THEN least(importance, 7) ELSE importance END AS importance FROM r WHERE CASE WHEN ratio < 0.3 THEN least(importance, 7) ELSE importance END >= 5""")
def provenance(role):
    rows = role("conversations")
    said = rows.filter("role = 'user'").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.lower("text").alias("t")))), lambda r: r["t"]), " ").alias("said"))
    words = F.filter(F.split(F.lower("text"), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: F.length(w) >= 4)
    facts = rows.filter("role = 'assistant'").join(said, "conv_id", "left").select("conv_id", "turn", F.coalesce("said", F.lit("")).alias("said"), words.alias("words"), (F.length("text") % 10 + 1).cast("long").alias("importance"))
    ratio = F.when(F.size("words") == 0, 1.0).otherwise(F.size(F.filter("words", lambda w: F.contains(F.col("said"), w))) / F.when(F.size("words") > 0, F.size("words")))
    facts = facts.withColumn("ratio", ratio)
    lax = F.when(F.col("ratio") < 0.3, F.least("importance", F.lit(7))).otherwise(F.col("importance"))
    return facts.select("conv_id", "turn", F.round("ratio", 6).alias("ratio"), F.when(F.col("ratio") < 0.3, "assistant").otherwise("user").alias("source"), lax.alias("importance")).filter("importance >= 5")


@query("F13_vault_filter", "SELECT id FROM {facts} WHERE source = 'user' AND contains(lower(concat_ws(' ', text, lang)), 'the')")
def vault_filter(role):
    return role("facts").filter((F.col("source") == "user") & F.contains(F.lower(F.concat_ws(" ", "text", "lang")), F.lit("the"))).select("id")


@query("F14_stale_review", "SELECT id, created_at FROM {stored} WHERE is_active AND source <> '5-LOW' AND created_at < TIMESTAMP '2000-01-01' - INTERVAL 30 DAY ORDER BY created_at, id LIMIT 6")
def stale_review(role):
    old = F.lit("2000-01-01").cast("timestamp") - F.expr("INTERVAL 30 DAY")
    return role("stored").filter(F.col("is_active") & (F.col("source") != "5-LOW") & (F.col("created_at") < old)).orderBy("created_at", "id").limit(6).select("id", "created_at")


_CLAIM_SQL = """SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN '{"t":"pref","c":"short ' || doc_id || '","st":"p"}' WHEN 1 THEN '{"id":"x","text":"long ' || doc_id || '","type":"claim","pin_status":"pinned"}' WHEN 2 THEN '{"text":"old ' || doc_id || '","metadata":{"importance":0.5}}' WHEN 3 THEN '"bare ' || doc_id || '"' ELSE 'raw ' || doc_id END AS blob FROM {documents}"""


def _claims(role):
    i = F.col("doc_id").cast("string")
    blob = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit('{"t":"pref","c":"short '), i, F.lit('","st":"p"}')))
        .when(F.col("doc_id") % 5 == 1, F.concat(F.lit('{"id":"x","text":"long '), i, F.lit('","type":"claim","pin_status":"pinned"}')))
        .when(F.col("doc_id") % 5 == 2, F.concat(F.lit('{"text":"old '), i, F.lit('","metadata":{"importance":0.5}}')))
        .when(F.col("doc_id") % 5 == 3, F.concat(F.lit('"bare '), i, F.lit('"')))
        .otherwise(F.concat(F.lit("raw "), i))
    )
    return role("documents").select(F.col("doc_id").alias("id"), blob.alias("blob"))


def claim_text(blob):
    """The text of a stored claim in any of its forms."""
    bare = F.when(blob.rlike(r'^".*"$'), F.regexp_replace(blob, r'^"|"$', ""))
    return F.coalesce(F.get_json_object(blob, "$.text"), F.get_json_object(blob, "$.c"), bare, blob)


@query("F15_pinned", f"SELECT id, coalesce(json_extract_string(j, '$.pin_status') = 'pinned', json_extract_string(j, '$.st') = 'p', false) AS pinned FROM (SELECT id, CASE WHEN json_valid(blob) THEN blob END AS j FROM ({_CLAIM_SQL}))".replace("{documents}", "{documents}"))
def pinned(role):
    blob = F.col("blob")
    return _claims(role).select("id", F.coalesce(F.get_json_object(blob, "$.pin_status") == "pinned", F.get_json_object(blob, "$.st") == "p", F.lit(False)).alias("pinned"))


@query("F16_blob_text", f"SELECT id, coalesce(json_extract_string(j, '$.text'), json_extract_string(j, '$.c'), CASE WHEN starts_with(blob, '\"') THEN trim(blob, '\"') END, blob) AS text FROM (SELECT id, blob, CASE WHEN json_valid(blob) THEN blob END AS j FROM ({_CLAIM_SQL}))")
def blob_text(role):
    return _claims(role).select("id", claim_text(F.col("blob")).alias("text"))


_MAP_SQL = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPE_MAP.items())


@query("F17_type_mapping", f"SELECT p_partkey, CASE list_extract(['fact', 'rule', 'goal', 'episodic', 'odd'], CAST(p_partkey % 5 + 1 AS INTEGER)) {_MAP_SQL} ELSE 'claim' END AS type FROM {{part}}")
def type_mapping(role):
    known = F.create_map(*[F.lit(x) for kv in TYPE_MAP.items() for x in kv])
    name = F.get(F.array(*map(F.lit, ("fact", "rule", "goal", "episodic", "odd"))), (F.col("p_partkey") % 5).cast("int"))
    return role("part").select("p_partkey", F.coalesce(F.try_element_at(known, name), F.lit("claim")).alias("type"))


@query("F18_lossy_enum", "SELECT o_orderkey, CASE lower(replace(replace(trim(' ' || substr(o_orderpriority, 3) || ' '), '_', '-'), ' ', '-')) WHEN 'not-specified' THEN 'unspecified' WHEN 'urgent' THEN 'urgent' WHEN 'high' THEN 'high' ELSE 'other' END AS scope FROM {orders}")
def lossy_enum(role):
    name = F.translate(F.lower(F.trim(F.concat(F.lit(" "), F.substring("o_orderpriority", 3, 100), F.lit(" ")))), "_ ", "--")
    return role("orders").select("o_orderkey", F.when(name == "not-specified", "unspecified").when(name.isin("urgent", "high"), name).otherwise("other").alias("scope"))


@query("F21_min_score_snippet", "SELECT id, substr(text, 1, 500) AS snippet FROM {facts} WHERE decay_score >= 0.8")
def min_score_snippet(role):
    return role("facts").filter("decay_score >= 0.8").select("id", F.substring("text", 1, 500).alias("snippet"))


@query("F22_stale_imports", "SELECT user_id, min(ts) AS began, CASE WHEN count(*) FILTER (event_type = 'purchase') = 0 THEN max(ts) < TIMESTAMP '2024-01-31' - INTERVAL 2 HOUR ELSE max(ts) < TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR END AS stale FROM {events} GROUP BY 1")
def stale_imports(role):
    now = F.lit("2024-01-31").cast("timestamp")
    last = F.max("ts").cast("timestamp")
    none = F.count_if(F.col("event_type") == "purchase") == 0
    return role("events").groupBy("user_id").agg(F.min("ts").alias("began"), F.when(none, last < now - F.expr("INTERVAL 2 HOURS")).otherwise(last < now - F.expr("INTERVAL 24 HOURS")).alias("stale"))


@query("F23_indexed_confirmation", """SELECT event_id, coalesce(json_extract_string(b, '$.data.fact.k'), json_extract_string(b, '$.fact.k')) IS NOT NULL AS indexed FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"data":{"fact":' || props || '}}' WHEN 1 THEN '{"fact":' || props || '}' ELSE '{"fact":null}' END AS b FROM {events})""".replace('{"data"', '{"data"'))
def indexed_confirmation(role):
    body = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"data":{"fact":'), "props", F.lit("}}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"fact":'), "props", F.lit("}"))).otherwise(F.lit('{"fact":null}'))
    return role("events").select("event_id", F.coalesce(F.get_json_object(body, "$.data.fact.k"), F.get_json_object(body, "$.fact.k")).isNotNull().alias("indexed"))


@query("C31_default_volatility", "SELECT doc_id AS id, CASE WHEN lang = 'en' THEN 'stable' WHEN source LIKE '%1' THEN 'ephemeral' ELSE 'updatable' END AS volatility FROM {documents}")
def default_volatility(role):
    return role("documents").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", "stable").when(F.col("source").like("%1"), "ephemeral").otherwise("updatable").alias("volatility"))


@query("C36_recall_context", "SELECT owner, 'Relevant memories:' || chr(10) || string_agg('- [' || source || '] (' || strftime(to_timestamp(created_at), '%Y-%m-%d') || ') ' || text, chr(10) ORDER BY created_at DESC, id) AS context FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY created_at DESC, id) AS k FROM {facts}) WHERE k <= 8 GROUP BY 1")
def recall_context(role):
    """What a recall of an owner's newest facts hands on: as many as a recall gives, whole."""
    newest = F.row_number().over(W.partitionBy("owner").orderBy(F.desc("created_at"), "id"))
    line = F.concat(F.lit("- ["), "source", F.lit("] ("), F.date_format(F.timestamp_seconds("created_at"), "yyyy-MM-dd"), F.lit(") "), "text")
    lines = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("created_at")).alias("t"), "id", line.alias("line")))), lambda r: r["line"])
    return role("facts").withColumn("k", newest).filter("k <= 8").groupBy("owner").agg(F.concat(F.lit("Relevant memories:\n"), F.array_join(lines, "\n")).alias("context"))


@query("C37_pending_duplicates", r"""
WITH n AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(trim(lower(text)), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM {conversations}),
o AS (SELECT *, unnest([lag(t, 1) OVER w, lag(t, 2) OVER w, lag(t, 3) OVER w]) AS other FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, coalesce(bool_or(t <> '' AND other <> '' AND (contains(other, t) OR contains(t, other))), false) AS duplicate FROM o GROUP BY 1, 2""")
def pending_duplicates(role):
    """Whether a turn's text holds, or is held in, one of the three turns before it."""
    per = W.partitionBy("conv_id").orderBy("turn")
    rows = role("conversations").select("conv_id", "turn", T.loose(F.col("text")).alias("t"))
    rows = rows.withColumn("others", F.array(*[F.lag("t", k).over(per) for k in (1, 2, 3)]))
    held = F.exists("others", lambda o: (o != "") & (F.contains(o, F.col("t")) | F.contains(F.col("t"), o)))
    return rows.select("conv_id", "turn", F.coalesce((F.col("t") != "") & held, F.lit(False)).alias("duplicate"))


@query("FN_format_age", "SELECT event_id, CASE WHEN s < 60 THEN CAST(s AS BIGINT) || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' WHEN s < 2592000 THEN s // 86400 || 'd ago' WHEN s < 31536000 THEN s // 2592000 || 'mo ago' ELSE s // 31536000 || 'y ago' END AS age FROM (SELECT event_id, CAST(event_id * event_id AS BIGINT) AS s FROM {events})")
def format_age(role):
    return role("events").select("event_id", T.format_age(F.col("event_id") * F.col("event_id")).alias("age"))


@query("FN_strip_html", r"SELECT page_id, length(trim(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]*>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '))) AS chars FROM {pages}".replace('\\"', '"'))
def strip_html(role):
    return role("pages").select("page_id", F.length(T.strip_html(F.col("html"))).cast("long").alias("chars"))


@query("FN_path_shape", r"SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '://[^/]*([^?#]*)', 1), '/[0-9a-fA-F]{32,}', '/{hash}', 'g'), '/[0-9]+', '/{n}', 'g') AS path FROM {pages}")
def path_shape(role):
    return role("pages").select("page_id", T.path_shape(F.regexp_extract("url", "://[^/]*([^?#]*)", 1)).alias("path"))


@query("FN_hmac_fingerprint", r"""SELECT doc_id, sha256('%s'::BLOB || unhex(sha256('%s'::BLOB || encode(trim(regexp_replace(lower(nfc_normalize(text)), '\s+', ' ', 'g')))))) AS fp FROM {documents}""" % (r"\x37" * 32 + r"\x5C" * 32, r"\x5D" * 32 + r"\x36" * 32))
def hmac_fingerprint(role):
    return role("documents").select("doc_id", T.fingerprint(F.col("text"), b"k" * 32).alias("fp"))


_VOCABULARY_SQL = r"""
WITH tok AS (SELECT id, unnest(t) AS token, unnest(range(len(t))) AS place FROM (SELECT %s AS id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: strlen(x) >= 2) AS t FROM {%s})),
vocab AS (SELECT DISTINCT token FROM tok), stems AS (%s),
terms AS (SELECT token, 0 AS kind, sha256(token) AS hash FROM vocab UNION ALL SELECT token, 1, sha256('stem:' || stem) FROM stems WHERE strlen(stem) >= 2),
first AS (SELECT id, hash, min(place * 2 + kind) AS pos FROM tok JOIN terms USING (token) GROUP BY 1, 2)
"""


def vocabulary_sql(id_col: str, table: str) -> str:
    """first (id, hash, pos): a text's digests of words and stems, and where they first occur."""
    return _VOCABULARY_SQL % (id_col, table, stems_sql("vocab"))


@query("FN_blind_indices", vocabulary_sql("item_id", "benchmark") + "SELECT item_id, coalesce(hashes, '') AS hashes FROM {benchmark} LEFT JOIN (SELECT id, string_agg(hash, ',' ORDER BY pos) AS hashes FROM first GROUP BY id) ON id = item_id")
def blind_indices(role):
    listed = R.blind_indices(role("benchmark"), id_col="item_id")
    return listed.select("item_id", F.array_join("hashes", ",").alias("hashes"))


@query("FN_iso_to_unix", "SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 1996 AND 2100 THEN CAST(epoch(o_orderdate) AS BIGINT) ELSE 0 END AS unix FROM {orders}")
def iso_to_unix(role):
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    at = F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssX"))
    return role("orders").select("o_orderkey", F.when(F.year(at).between(1996, 2100), F.unix_timestamp(at)).otherwise(F.lit(0)).alias("unix"))


@query("FN_hex_base64", "SELECT p_partkey, base64(unhex(md5(p_name))) AS b64 FROM {part}")
def hex_base64(role):
    return role("part").select("p_partkey", F.base64(F.unhex(F.md5("p_name"))).alias("b64"))
