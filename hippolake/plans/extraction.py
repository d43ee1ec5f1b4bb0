"""Queries: deterministic parts around extraction: entities of a query, importance from words, memory texts, envelopes, caches, codecs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hippolake.functions import embedding as E
from hippolake.functions.arrays import scan
from hippolake.functions.vectors import cosine
from hippolake.operators import retrieval as R
from hippolake.plans import retrieval as PR
from hippolake.functions import text as T
from hippolake.plans.catalog import query

# What a conversation says of a fact's importance, and words that say nothing of it.
STRONG_INTENT = r"\b(remember this|never forget|rule of thumb|don't (?:ever )?forget|critical|important|gotcha|note to self)\b"
CAPITALS = r"\b[A-Z]{3,}(?:\s+[A-Z]{3,}){2,}\b"
UNREMARKABLE = (
    "about after again against because before being between could doing during every further having their these those through under until where which while would should "
    "thing things something someone always never often still really maybe using works user users with from into like just than them they will when what were this that have"
).split()

# Expressions of entities in a query, words that are none, and words of common domains.
PHRASE, ACRONYM = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}\b", r"\b[A-Z]{2,5}\b"
MONTH_DATE = r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+[0-9]{1,2}(?:,?\s+[0-9]{4})?\b"
SLASH_DATE = r"\b[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}\b"
NO_ENTITY = (
    "i my me mine we our ours you your yours he she it they their them a an the and or but if then so because as of at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further do does did have has had is are was were be been being this that these those what which who whom whose where why how "
    "all any both each few more most other some such no nor not only own same than too very can will just should now also one two three first second third last next today tomorrow yesterday "
    "week month year day time minute hour quick fine sure okay ok yes yeah nope please sorry thanks thank really actually basically definitely probably maybe perhaps"
).split()
DOMAIN_WORDS = (
    "gps wifi vpn iphone android samsung google apple tesla honda toyota bmw kia ev4 ev6 airbnb uber spotify youtube netflix linkedin github docker kubernetes wireguard postgres mysql redis "
    "python rust typescript javascript solidity january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday "
    "breakfast lunch dinner workshop webinar meeting conference class course training gym run hike flight trip vacation car phone laptop headphones tv recipe flour sugar butter eggs salt pepper "
    "garlic ginger onion tomato rice pasta bsl mit apache license contract agreement"
).split()

_SQL_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_Q = lambda pattern: pattern.replace("'", "''")


def query_entities(text: Column) -> Column:
    """array<string>: capitalised phrases, capitalised words that don't begin a sentence, words of known domains, acronyms and dates; lower case, each once, in that order."""
    normal = lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    every = lambda pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), normal)
    known = lambda words: F.array(*map(F.lit, words))
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    words = F.transform(tokens, lambda t, i: F.struct(F.regexp_replace(t, "[^A-Za-z0-9]", "").alias("w"), ((i == 0) | F.get(tokens, i - 1).rlike("[.!?]$")).alias("begins")))
    single = F.transform(F.filter(words, lambda x: ~x["begins"] & x["w"].rlike("^[A-Z][a-z]{2,}$")), lambda x: F.lower(x["w"]))
    plain = lambda found: F.filter(found, lambda x: ~F.array_contains(known(NO_ENTITY), x))
    domain = F.filter(known(DOMAIN_WORDS), lambda s: F.array_contains(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), s))
    return F.array_distinct(F.concat(every(PHRASE), plain(single), domain, plain(every(ACRONYM)), every(MONTH_DATE), every(SLASH_DATE)))


_ENTITIES_SQL = rf"""
WITH asks AS (SELECT conv_id, turn, text FROM {{conversations}} WHERE text IS NOT NULL),
tok AS (SELECT *, list_filter(string_split_regex(text, '\s+'), lambda t: t <> '') AS t, regexp_replace(regexp_replace(text, '[^\x00-\x7F\p{{{{L}}}}\p{{{{N}}}}]', '.', 'g'), '[^\x00-\x7F]', '_', 'g') AS plain FROM asks), -- this engine's \b knows ASCII only
found AS (SELECT conv_id, turn, list_concat(list_concat(list_concat(
   list_transform(regexp_extract_all(plain, '{PHRASE}'), lambda x: trim(regexp_replace(lower(x), '\s+', ' ', 'g'))),
   list_filter(list_transform(list_filter(range(2, len(t) + 1), lambda i: NOT regexp_matches(t[i - 1], '[.!?]$') AND regexp_matches(regexp_replace(t[i], '[^A-Za-z0-9]', '', 'g'), '^[A-Z][a-z]{{{{2,}}}}$')), lambda i: lower(regexp_replace(t[i], '[^A-Za-z0-9]', '', 'g'))), lambda x: NOT list_contains({_SQL_LIST(NO_ENTITY)}, x))),
   list_concat(list_filter({_SQL_LIST(DOMAIN_WORDS)}, lambda s: list_contains(string_split_regex(lower(text), '[^\p{{{{L}}}}\p{{{{N}}}}_]+'), s)),
   list_filter(list_transform(regexp_extract_all(plain, '{ACRONYM}'), lambda x: lower(x)), lambda x: NOT list_contains({_SQL_LIST(NO_ENTITY)}, x)))),
   list_concat(list_transform(regexp_extract_all(plain, '{MONTH_DATE}'), lambda x: trim(regexp_replace(lower(x), '\s+', ' ', 'g'))), regexp_extract_all(plain, '{SLASH_DATE}'))) AS e FROM tok)
SELECT conv_id, turn, array_to_string(list_filter(e, lambda x, i: list_position(e, x) = i), ',') AS entities FROM found
"""


@query("C30_query_entities", _ENTITIES_SQL.replace("{{", "{").replace("}}", "}"))
def entities_of_queries(role):
    return role("conversations").filter("text is not null").select("conv_id", "turn", F.array_join(query_entities(F.col("text")), ",").alias("entities"))


@query("C28_importance_bump", rf"""
WITH said AS (SELECT conv_id, max(CAST(regexp_matches(lower(text), '{_Q(STRONG_INTENT)}') AS INTEGER)) AS strong, max(CAST(contains(text, '!!') OR regexp_matches(text, '{CAPITALS}') AS INTEGER)) AS loud FROM {{conversations}} GROUP BY 1),
words AS (SELECT conv_id, w, count(*) AS n FROM (SELECT conv_id, unnest(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+')) AS w FROM {{conversations}}) GROUP BY 1, 2),
own AS (SELECT DISTINCT conv_id, turn, unnest(string_split_regex(lower(text), '[^a-z0-9_]+')) AS w FROM {{conversations}}),
again AS (SELECT o.conv_id, o.turn FROM own o JOIN words USING (conv_id, w) WHERE n >= 2 AND length(w) >= 5 AND NOT list_contains({_SQL_LIST(UNREMARKABLE)}, w) GROUP BY 1, 2)
SELECT c.conv_id, c.turn, least(strong + loud + CASE WHEN a.turn IS NULL THEN 0 ELSE 1 END, 2) AS bump FROM {{conversations}} c JOIN said USING (conv_id) LEFT JOIN again a ON a.conv_id = c.conv_id AND a.turn = c.turn""".replace("{{", "{").replace("}}", "}"))
def importance_bump(role):
    """0 to 2 for each turn as a fact: its conversation asks for it, is loud, or repeats one of its longer words. Words are counted per conversation, not in its joined text."""
    turns = role("conversations")
    said = turns.groupBy("conv_id").agg(F.max(F.lower("text").rlike(STRONG_INTENT).cast("int")).alias("strong"), F.max((F.contains("text", F.lit("!!")) | F.col("text").rlike(CAPITALS)).cast("int")).alias("loud"))
    words = turns.select("conv_id", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")).alias("w")).groupBy("conv_id", "w").agg(F.count("*").alias("n")).filter("n >= 2 and length(w) >= 5")
    own = turns.select("conv_id", "turn", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9_]+"))).alias("w")).filter((F.length("w") >= 5) & ~F.col("w").isin(*UNREMARKABLE))
    again = own.join(words, ["conv_id", "w"], "left_semi").select("conv_id", "turn").distinct().withColumn("again", F.lit(1))
    out = turns.select("conv_id", "turn").join(said, "conv_id").join(again, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", F.least(F.col("strong") + F.col("loud") + F.coalesce("again", F.lit(0)), F.lit(2)).alias("bump"))


# Header lines, dates and marks before a memory, and the lines of a chunk.
MEMORY_HEADER = r"(?i)^(?:memories?|chatgpt memories?|claude memories?|my memories?|saved memories?):?\s*$"
DATE_PREFIX = r"^\[([0-9]{4}-[0-9]{2}-[0-9]{2})\]\s*[-:]\s*"
CHUNK_LINES = 20


@query("S13_memory_lines", rf"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM {{documents}}),
cut AS (SELECT doc_id, n, trim(line, ' ' || chr(9) || chr(13)) AS line FROM lines),
kept AS (SELECT doc_id, n, regexp_extract(line, '{DATE_PREFIX}', 1) AS day, trim(regexp_replace(regexp_replace(regexp_replace(line, '{DATE_PREFIX}', ''), '^[-*•]\s+', ''), '^[0-9]+[.)]\s+', '')) AS memory FROM cut WHERE line <> '' AND NOT regexp_matches(line, '{MEMORY_HEADER}')),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS place FROM kept WHERE length(memory) >= 3)
SELECT doc_id, place, place // {CHUNK_LINES} AS chunk, nullif(day, '') AS day, memory FROM numbered""".replace("{{", "{").replace("}}", "}"))
def memory_lines(role):
    """Memories as text, one a line: headers go, dates before them are kept apart, bullets and numbers go; in chunks of CHUNK_LINES."""
    lines = role("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("line", F.trim(F.col("line"), F.lit(" \t\r")))
    lines = lines.filter((F.col("line") != "") & ~F.col("line").rlike(MEMORY_HEADER))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("line", DATE_PREFIX, ""), r"^[-*•]\s+", ""), r"^[0-9]+[.)]\s+", "")
    day = F.regexp_extract("line", DATE_PREFIX, 1)
    kept = lines.select("doc_id", "n", F.when(day != "", day).alias("day"), F.trim(bare).alias("memory")).filter(F.length("memory") >= 3)
    place = (F.row_number().over(W.partitionBy("doc_id").orderBy("n")) - 1).cast("long")
    return kept.select("doc_id", place.alias("place"), F.floor(place / CHUNK_LINES).alias("chunk"), "day", "memory")


def enveloped(text: Column, which: Column) -> Column:
    """Every third text in an envelope, and each that could be taken for one; others bare."""
    put_in = text.isNotNull() & ((which % 3 == 0) | F.trim(text).startswith("{"))
    return F.when(put_in, F.to_json(F.struct(text.alias("t"), F.lit("agent").alias("a")))).otherwise(text)


def opened(blob: Column) -> Column:
    """The text in an envelope {"t": text, ...}; what is none is text itself."""
    return F.coalesce(F.when(F.trim(blob).startswith("{"), F.get_json_object(blob, "$.t")), blob)


@query("H16_envelope_rerank", PR.CORE_SQL + PR.COSINE_SQL + PR.fused_sql(False))
def envelope_rerank(role):
    """The fused ranking of facts whose texts come in envelopes; without an embedding a fact counts as unlike anything.

    What is searched and scored are the opened texts: the postings are built from them, and a fact's own columns from its row.
    """
    stored = role("fact_rows").withColumn("text", enveloped(F.col("text"), F.col("id")))
    facts = stored.withColumn("text", opened(F.col("text")))
    seen = lambda view: facts if view == "fact_rows" else role(view)
    return PR._shown(R.top_k(R.fuse(PR.scored(seen)), PR.KEEP))


@query("H17_semantic_cache", """
WITH RECURSIVE rows AS (SELECT label, vec_id, embedding AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM {embeddings}),
walk AS (SELECT label, k, vec_id, [{'i': vec_id, 'v': v}] AS held, CAST(NULL AS BIGINT) AS hit FROM rows WHERE k = 1
  UNION ALL SELECT label, k, vec_id, CASE WHEN hit IS NULL THEN list_append(CASE WHEN len(held) >= 30 THEN held[2:] ELSE held END, {'i': vec_id, 'v': v}) ELSE held END, hit
  FROM (SELECT x.label, x.k, x.vec_id, x.v, w.held, list_filter(w.held, lambda h: round(list_dot_product(CAST(h.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) / (sqrt(list_dot_product(CAST(h.v AS DOUBLE[]), CAST(h.v AS DOUBLE[]))) * sqrt(list_dot_product(CAST(x.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])))), 12) >= 0.2)[1].i AS hit FROM walk w JOIN rows x ON x.label = w.label AND x.k = w.k + 1))
SELECT label, vec_id, hit FROM walk""")
def semantic_cache(role):
    """Queries of each user in order: one like a cached one is answered by the first such; others are cached, the oldest of 30 leaving."""
    listed = role("embeddings").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("asked"))
    kind = dict(role("embeddings").dtypes)

    def step(held: Column, x: Column) -> tuple[Column, Column]:
        hit = F.get(F.filter(held, lambda h: F.round(cosine(h["embedding"], x["embedding"]), 12) >= 0.2), 0)["vec_id"]
        grown = F.concat(F.when(F.size(held) >= 30, F.slice(held, 2, 29)).otherwise(held), F.array(x))
        return F.when(hit.isNull(), grown).otherwise(held), F.struct(x["vec_id"].alias("vec_id"), hit.alias("hit"))

    none = F.array().cast(f"array<struct<vec_id:{kind['vec_id']},embedding:{kind['embedding']}>>")
    return listed.select("label", F.inline(scan(F.col("asked"), none, step, f"struct<vec_id:{kind['vec_id']},hit:{kind['vec_id']}>")))


@query("FN_embedding_codec", "SELECT vec_id, embedding FROM {embeddings}")
def embedding_codec(role):
    return role("embeddings").select("vec_id", E.decoded(E.encoded(F.col("embedding"))).alias("embedding"))


@query("FN_session_uuid", f"SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS session_id FROM (SELECT c_custkey, sha1(unhex('{E.SESSION_NAMESPACE.replace('-', '')}') || encode(c_name)) AS h FROM {{customer}})")
def session_uuid(role):
    return role("customer").select("c_custkey", E.uuid5(F.col("c_name")).alias("session_id"))


# Fixed value: characters of a digest's prompt text.
PROMPT_CHARS = 2000
_INDICES = r"^\[(?:[1-9][0-9]*(?:,[1-9][0-9]*)*)?\]$"
_NAMES = r'^\[(?:"(?:[^"\\]|\\.)*"(?:,"(?:[^"\\]|\\.)*")*)?\]$'


def digest_parts(response: Column) -> Column:
    """struct<error, identity, top, recent, projects> of a response that names claims by their numbers from 1, with or without a fence around it.

    error says what is wrong with it, and is null where nothing is: no object, no identity, or a list that isn't one of positive numbers (of texts).
    """
    body = F.trim(T.without_closing_fence(F.regexp_replace(F.trim(response), r"^```[^\n]*\n", "")))
    field = lambda name: F.get_json_object(body, f"$.{name}")
    bad = lambda name, shape: field(name).isNotNull() & ~F.regexp_replace(field(name), r"\s*,\s*", ",").rlike(shape)
    whole = F.from_json(body, "struct<top_claim_indices:array<int>,recent_decision_indices:array<int>,active_project_names:array<string>>")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    error = (
        F.when(~F.coalesce(body.rlike(r"(?s)^\{.*\}$"), F.lit(False)) | F.try_parse_json(body).isNull(), "no object")
        .when(F.coalesce(field("identity"), F.lit("")) == "", "identity")
        .when(bad("top_claim_indices", _INDICES), "top_claim_indices")
        .when(bad("recent_decision_indices", _INDICES), "recent_decision_indices")
        .when(bad("active_project_names", _NAMES), "active_project_names")
    )
    return F.struct(
        error.alias("error"), field("identity").alias("identity"), F.coalesce(whole["top_claim_indices"], none("int")).alias("top"),
        F.coalesce(whole["recent_decision_indices"], none("int")).alias("recent"), F.coalesce(whole["active_project_names"], none("string")).alias("projects"),
    )


def digest_prompt(parts: Column, claims: Column) -> Column:
    """The prompt text of a parsed response over an array of texts; null where it has an error or a number beyond them."""
    within = F.forall(F.concat(parts["top"], parts["recent"]), lambda i: i <= F.size(claims))
    lines = lambda numbers: F.array_join(F.transform(numbers, lambda i: F.concat(F.lit("- "), F.get(claims, i - 1), F.lit("\n"))), "")
    section = lambda title, numbers: F.when(F.size(numbers) > 0, F.concat(F.lit(title), lines(numbers))).otherwise("")
    projects = F.when(F.size(parts["projects"]) > 0, F.concat(F.lit("\nActive projects: "), F.array_join(parts["projects"], ", "), F.lit("\n"))).otherwise("")
    text = F.concat(F.trim(parts["identity"]), section("\n\nKey facts:\n", parts["top"]), section("\nRecent decisions:\n", parts["recent"]), projects)
    return F.when(parts["error"].isNull() & within, F.substring(F.rtrim(text, F.lit(T.SPACES)), 1, PROMPT_CHARS))


@query("C20_digest_assembly", f"""
WITH c AS (SELECT owner, id, 'fact ' || id || ' of ' || source AS t, row_number() OVER (PARTITION BY owner ORDER BY created_at DESC, id) AS k FROM {{facts}}),
l AS (SELECT owner, list(t ORDER BY k) AS t FROM c WHERE k <= 10 GROUP BY 1)
SELECT owner, CASE owner WHEN 3 THEN 'no object' WHEN 4 THEN 'identity' WHEN 5 THEN 'top_claim_indices' END AS error,
 CASE WHEN owner IN (3, 4, 5, 6) THEN NULL ELSE 'Owner ' || owner || chr(10) || chr(10) || 'Key facts:' || chr(10) || '- ' || t[1] || chr(10) || '- ' || t[3] || chr(10) || chr(10) || 'Recent decisions:' || chr(10) || '- ' || t[2] || CASE WHEN owner = 2 THEN chr(10) || chr(10) || 'Active projects: a, b' ELSE '' END END AS prompt FROM l""".replace("{{", "{").replace("}}", "}"))
def digest_assembly(role):
    """A response for each owner, good and bad ones, put together with the owner's ten newest facts."""
    newest = F.row_number().over(W.partitionBy("owner").orderBy(F.desc("created_at"), "id"))
    claims = role("facts").withColumn("k", newest).filter("k <= 10").withColumn("t", F.concat(F.lit("fact "), F.col("id").cast("string"), F.lit(" of "), "source"))
    held = claims.groupBy("owner").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]).alias("claims"))
    owner = F.col("owner")
    good = F.format_string('{"identity": " Owner %d ", "top_claim_indices": [1, 3], "recent_decision_indices": [2]}', owner)
    response = (
        F.when(owner == 0, good).when(owner == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(owner == 2, F.regexp_replace(good, r"\}$", ', "active_project_names": ["a", "b"]}'))
        .when(owner == 3, F.lit("I can't say.")).when(owner == 4, F.lit('{"top_claim_indices": []}')).when(owner == 5, F.regexp_replace(good, r"\[1, 3\]", "[0, 1]")).otherwise(F.regexp_replace(good, r"\[2\]", "[11]"))
    )
    made = held.withColumn("parts", digest_parts(response))
    return made.select("owner", F.col("parts.error").alias("error"), digest_prompt(F.col("parts"), F.col("claims")).alias("prompt"))


def salvaged(response: Column, opens: str) -> Column:
    """The JSON object ('{') or array ('[') in a response: all of it, within a fence, or from the first mark that opens one to the last that closes one; null if that isn't JSON."""
    body = T.without_closing_fence(F.regexp_replace(F.trim(response), r"^```[^\n]*\n", ""))
    found = F.regexp_extract(body, r"(?s)\{.*\}" if opens == "{" else r"(?s)\[.*\]", 0)
    return F.when((found != "") & F.try_parse_json(found).isNotNull(), found)


def triage(response: Column) -> Column:
    """array<struct<chunk, decision, reason>> of a response about chunks; what isn't said to be skipped is extracted, and entries without a number are left out."""
    entry = "struct<index:bigint,chunk_index:bigint,decision:string,reason:string>"
    entries = F.coalesce(F.from_json(salvaged(response, "["), f"array<{entry}>"), F.array().cast(f"array<{entry}>"))
    named = F.transform(entries, lambda e: F.struct(F.coalesce(e["index"], e["chunk_index"]).alias("chunk"), F.when(F.upper(e["decision"]) == "SKIP", "SKIP").otherwise("EXTRACT").alias("decision"), F.coalesce(e["reason"], F.lit("")).alias("reason")))
    return F.filter(named, lambda e: e["chunk"] >= 0)


PROFILE_LISTS = ("themes", "projects", "stack", "decisions", "interests", "skip_patterns")


def profile(response: Column) -> Column:
    """struct of identity (null if it says nothing) and PROFILE_LISTS of a response; all empty where no object can be made out."""
    read = F.from_json(salvaged(response, "{"), "struct<identity:string," + ",".join(f"{p}:array<string>" for p in PROFILE_LISTS) + ">")
    lists = [F.filter(F.coalesce(read[p], F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")).alias(p) for p in PROFILE_LISTS]
    return F.struct(F.when(~read["identity"].isin("", "null"), read["identity"]).alias("identity"), *lists)


@query("C33_triage_and_profile", """
SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 0 ELSE 2 END AS decisions, CASE WHEN turn % 4 <> 3 AND role = 'user' THEN 1 ELSE 0 END AS skipped, CASE WHEN turn % 4 = 3 OR role = 'system' THEN NULL ELSE role END AS identity, CASE WHEN turn % 4 = 3 THEN '' ELSE 'a,' || role END AS themes FROM {conversations}""")
def triage_and_profile(role):
    """Responses about each turn's chunks and user: bare, in a fence, with talk around them, and cut short."""
    who, kind = F.col("role"), F.col("turn") % 4
    said = F.when(who == "user", "skip").otherwise("Keep")
    about = F.concat(F.lit('[{"index": 0, "decision": "'), said, F.lit('", "reason": "[r]"}, {"chunk_index": 1}, {"decision": "SKIP"}]'))
    user = F.concat(F.lit('{"identity": "'), F.when(who == "system", "null").otherwise(who), F.lit('", "themes": ["a", "", "'), who, F.lit('"], "other": {"x": 1}}'))
    shaped = lambda text: F.when(kind == 0, text).when(kind == 1, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here it is: "), text, F.lit(" Done."))).otherwise(F.expr("NULL").cast("string"))
    cut = lambda text: F.coalesce(shaped(text), F.substring(text, 1, 20))
    made = role("conversations").select("conv_id", "turn", triage(cut(about)).alias("t"), profile(cut(user)).alias("p"))
    return made.select("conv_id", "turn", F.size("t").alias("decisions"), F.size(F.filter("t", lambda e: e["decision"] == "SKIP")).alias("skipped"), F.col("p.identity").alias("identity"), F.array_join("p.themes", ",").alias("themes"))
