"""Readers of exported memories and chats. Each takes (id, content) rows and returns rows; content is one export file.

Malformed content gives no rows, never an error: parsing goes through functions that return null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hippolake.functions.text import SPACES

CHUNK = 20

# Headings of pasted lists, categories and their types, pronouns and relations in words, months by their first three letters.
HEADINGS = ("saved info", "gemini saved info", "personal context", "things gemini knows")
CATEGORIES = {
    "preference": "preference", "preferences": "preference", "like": "preference", "dislike": "preference", "fact": "fact", "personal": "fact", "biographical": "fact",
    "decision": "decision", "goal": "goal", "objective": "goal", "experience": "episodic", "event": "episodic", "memory": "episodic",
}
PRONOUNS = ("he ", "she ", "they ", "it ", "his ", "her ", "their ", "its ")
RELATIONS = {
    "works on": "works on", "works at": "works at", "member of": "is a member of", "belongs to": "belongs to", "created by": "was created by", "depends on": "depends on",
    "uses": "uses", "knows": "knows", "related to": "is related to", "part of": "is part of", "friend of": "is friends with", "manages": "manages",
    "reports to": "reports to", "located in": "is located in", "lives in": "lives in",
}
MONTHS = (
    ("jan", "gen"), ("feb", "fev", "fév"), ("mar", "mär"), ("apr", "abr", "avr"), ("may", "mai", "mag"), ("jun", "giu", "jui"),
    ("jul", "lug"), ("aug", "ago", "aoû", "aou"), ("sep", "set"), ("oct", "okt", "ott", "out"), ("nov",), ("dec", "dez", "dic", "déc"),
)


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def list_items(files: DataFrame, *, headings: tuple[str, ...] = HEADINGS) -> DataFrame:
    """id, item_no (from 0), chunk, text: the lines of a pasted list without headings, bullets and numbers, of three characters or more."""
    lines = files.select("id", F.posexplode(F.split("content", "\n")).alias("line_no", "raw")).withColumn("line", F.trim("raw", F.lit(SPACES)))
    plain = F.lower(F.trim(F.regexp_replace("line", ":+$", "")))
    kept = lines.filter((F.col("line") != "") & ~plain.isin(*headings))
    text = F.regexp_replace("line", r"^(?:[-*•]\s+|[0-9]+[.)]\s+)", "")
    kept = kept.withColumn("text", text).filter(F.length("text") >= 3)
    kept = kept.withColumn("item_no", (F.row_number().over(W.partitionBy("id").orderBy("line_no")) - 1).cast("long"))
    return kept.select("id", "item_no", F.floor(F.col("item_no") / CHUNK).cast("long").alias("chunk"), "text")


def month_number(token: Column) -> Column:
    """1 to 12 by the first three letters in six languages, null if unknown; July in French reads as June."""
    key = F.substring(F.lower(token), 1, 3)
    return F.try_element_at(_literal_map({name: i for i, names in enumerate(MONTHS, 1) for name in names}), key)


def activity_html(files: DataFrame) -> DataFrame:
    """id, cell_no, prompt, at (unix seconds or null): the prompted cells of an activity page; undated ones stay."""
    cells = files.select("id", F.posexplode(F.split("content", "outer-cell")).alias("cell_no", "cell")).filter("cell_no > 0").filter(F.contains("cell", F.lit("Prompted")))
    date = r"([0-9]{1,2}) (?:de )?([\p{L}]{3,})\.? (?:de )?([0-9]{4}),? ([0-9]{2}):([0-9]{2}):([0-9]{2})"
    part = lambda i: F.regexp_extract("cell", date, i)
    month = month_number(part(2))
    at = F.try_to_timestamp(F.format_string("%s-%02d-%02d %s:%s:%s", part(3), month, part(1).try_cast("int"), part(4), part(5), part(6)))
    prompt = F.regexp_replace(F.regexp_extract("cell", r"Prompted\s*([\s\S]*?)(?:<br|</div|$)", 1), r"<[^>]*>", "")
    return cells.select("id", "cell_no", F.trim(prompt).alias("prompt"), F.when(month.isNotNull(), F.unix_timestamp(at)).alias("at"))


def activity_json(files: DataFrame, product: str = "gemini") -> DataFrame:
    """id, record_no, prompt, response, at: records of the product (or without header), dropped if both sides are under three characters."""
    schema = "array<struct<header:string,title:string,time:string,safeHtmlItem:array<struct<html:string>>>>"
    records = files.select("id", F.posexplode(F.from_json("content", schema)).alias("record_no", "r"))
    header = F.coalesce("r.header", F.lit(""))
    prompt = F.regexp_replace(F.coalesce("r.title", F.lit("")), r"^(?:Prompted|Used)\s+", "")
    response = F.trim(F.regexp_replace(F.coalesce(F.get("r.safeHtmlItem", F.lit(0))["html"], F.lit("")), r"<[^>]*>", ""))
    kept = records.filter((header == "") | F.contains(F.lower(header), F.lit(product)))
    rows = kept.select("id", "record_no", prompt.alias("prompt"), response.alias("response"), F.unix_timestamp(F.try_to_timestamp("r.time")).alias("at"))
    return rows.filter((F.length("prompt") >= 3) | (F.length("response") >= 3))


def memory_export(files: DataFrame) -> DataFrame:
    """id, memory_id, text, type, importance 6: {memories: [...]}, {results: [...]} or a bare array of memories."""
    memory = "struct<id:string,memory:string,categories:array<string>,metadata:struct<category:string>>"
    wrapped = F.from_json("content", f"struct<memories:array<{memory}>,results:array<{memory}>>")
    bare = F.when(F.col("content").rlike(r"^\s*\["), F.from_json("content", f"array<{memory}>"))
    rows = files.select("id", F.explode(F.coalesce(wrapped["memories"], wrapped["results"], bare)).alias("m")).filter(F.length(F.trim("m.memory")) >= 3)
    names = F.concat(F.coalesce("m.categories", F.array().cast("array<string>")), F.array("m.metadata.category"))
    known = F.filter(F.transform(names, lambda c: F.try_element_at(_literal_map(CATEGORIES), F.coalesce(F.lower(c), F.lit("")))), lambda t: t.isNotNull())
    return rows.select("id", F.col("m.id").alias("memory_id"), F.trim("m.memory").alias("text"), F.coalesce(F.get(known, F.lit(0)), F.lit("fact")).alias("type"), F.lit(6).alias("importance"))


def contextualised(name: Column, observation: Column) -> Column:
    """An observation made to say whom it is about."""
    said = F.trim(observation)
    low = F.lower(said)
    out = F.when(F.startswith(low, F.lower(name)), said)
    for p in PRONOUNS:
        out = out.when(F.startswith(low, F.lit(p)), F.concat(name, F.lit(" "), F.substr(said, F.lit(len(p) + 1))))
    first = F.substring(said, 1, 1)
    return out.when(first == F.lower(first), F.concat(name, F.lit(" "), said)).otherwise(F.concat(name, F.lit(": "), said))


def graph_jsonl(files: DataFrame) -> DataFrame:
    """id, kind, text: facts of entities' observations and of relations whose two ends exist; of entities with one name the last counts."""
    lines = files.select("id", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    j = F.from_json("line", "struct<type:string,name:string,entityType:string,observations:array<string>,from:string,to:string,relationType:string>")
    parsed = lines.select("id", "line_no", j.alias("j")).filter("j is not null")
    entities = parsed.filter("j.type = 'entity' and j.name is not null").groupBy("id", F.col("j.name").alias("name")).agg(F.max_by("j.observations", "line_no").alias("observations"))
    observed = entities.select("id", "name", F.explode("observations").alias("o")).filter(F.length(F.trim("o")) >= 3)
    relations = parsed.filter("j.type = 'relation'").select("id", F.col("j.from").alias("source"), F.col("j.to").alias("target"), F.col("j.relationType").alias("relation"))
    for end in ("source", "target"):
        relations = relations.join(entities.select("id", F.col("name").alias(end)), ["id", end], "left_semi")
    slug = F.replace(F.lower("relation"), F.lit("_"), F.lit(" "))
    words = F.coalesce(F.try_element_at(_literal_map(RELATIONS), slug), slug)
    return observed.select("id", F.lit("entity").alias("kind"), contextualised(F.col("name"), F.col("o")).alias("text")).unionByName(relations.select("id", F.lit("relation").alias("kind"), F.concat_ws(" ", "source", words, "target").alias("text")))


def conversation_tree(files: DataFrame) -> DataFrame:
    """id, position, role, text: the thread a user sees in an exported chat, from its current node up to the root.

    Without a known current node the deepest leaf is taken. The walk runs inside one fold over the
    chat's own nodes, however long the thread, and stops at a node that it has seen.
    """
    node = "struct<parent:string,children:array<string>,message:struct<author:struct<role:string>,content:struct<parts:array<string>>>>"
    tree = F.from_json("content", f"struct<current_node:string,mapping:map<string,{node}>>")
    rows = files.select("id", tree.alias("t")).filter("t.mapping is not null").select("id", F.map_keys("t.mapping").alias("names"), F.map_values("t.mapping").alias("nodes"), F.col("t.current_node").alias("current"))

    place = lambda name: F.coalesce(F.array_position("names", name), F.lit(0)).cast("int")  # noqa: E731  (from 1; 0 is none)
    parents = F.transform("nodes", lambda x: place(x["parent"]))

    def chain(leaf: Column) -> Column:
        def up(acc: Column, _: Column) -> Column:
            at = F.get(acc["parents"], F.element_at(acc["path"], -1) - 1)
            goes = (at > 0) & ~F.array_contains(acc["path"], at)
            return F.struct(acc["parents"].alias("parents"), F.when(goes, F.concat(acc["path"], F.array(at))).otherwise(acc["path"]).alias("path"))

        # The parents travel in the fold, so that they are found once and not at each step.
        start = F.struct(parents.alias("parents"), F.array(leaf).alias("path"))
        return F.reverse(F.aggregate(F.sequence(F.lit(1), F.size("names")), start, up, lambda acc: acc["path"]))

    bare = F.transform("nodes", lambda x, i: F.when(F.coalesce(F.size(x["children"]), F.lit(0)) <= 0, i + 1))
    deepest = F.aggregate(F.transform(F.array_compact(bare), chain), F.array().cast("array<int>"), lambda acc, c: F.when(F.size(c) > F.size(acc), c).otherwise(acc))
    current = place(F.col("current"))
    thread = F.when(F.size("names") == 0, F.array().cast("array<int>")).when(current > 0, chain(current)).otherwise(deepest)
    path = rows.select("id", F.posexplode(F.transform(thread, lambda at: F.get("nodes", at - 1)["message"])).alias("position", "message"))
    out = path.select("id", "position", F.col("message.author.role").alias("role"), F.array_join("message.content.parts", "\n").alias("text"))
    return out.filter(F.col("role").isin("user", "assistant") & (F.length("text") >= 3))


def json_log(files: DataFrame, schema: str) -> DataFrame:
    """id, line_no (from 1), row, broken: the non-blank lines of a JSON log, parsed or marked broken."""
    lines = files.select("id", F.posexplode(F.split("content", "\n")).alias("line_no", "line")).filter(F.trim("line") != "")
    row = F.from_json("line", schema)
    shaped = F.trim("line").rlike(r"^\{[\s\S]*\}$")
    return lines.select("id", (F.col("line_no") + 1).alias("line_no"), F.when(shaped, row).alias("row"), (~shaped | row.isNull()).alias("broken"))


#: The readers by name of their source.
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "activity-html": activity_html,
    "activity-json": activity_json,
    "chat-tree": conversation_tree,
    "list": list_items,
    "memory-export": memory_export,
    "memory-graph": graph_jsonl,
}


def get_adapter(source: str) -> Callable[[DataFrame], DataFrame]:
    if source not in ADAPTERS:
        raise ValueError(f"unknown source {source!r}; known: {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[source]
