"""Queries: readers of exports, over files made of the tables' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from hippolake.plans.catalog import query
from hippolake.sources import imports as I


@query("S10_list_items", r"""
WITH l AS (SELECT doc_id AS id, string_split(text, chr(10)) AS l FROM {documents}), n AS (SELECT id, unnest(range(1, len(l) + 1)) AS i, l FROM l),
t AS (SELECT id, i, trim(regexp_replace(l[i], '^\s+|\s+$', '', 'g')) AS line FROM n),
k AS (SELECT id, i, regexp_replace(line, '^(?:[-*•]\s+|[0-9]+[.)]\s+)', '') AS text FROM t WHERE line <> '' AND lower(trim(regexp_replace(line, ':+$', ''))) NOT IN ('saved info', 'gemini saved info', 'personal context', 'things gemini knows')),
r AS (SELECT id, text, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS item_no FROM k WHERE length(text) >= 3)
SELECT id, item_no, item_no // 20 AS chunk, text FROM r""")
def list_items(role):
    return I.list_items(role("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


@query("S11_chat_tree", "SELECT conv_id AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, role, text FROM {conversations} QUALIFY role IN ('user', 'assistant') AND length(text) >= 3")
def chat_tree(role):
    """Every conversation as an exported chat whose nodes are its turns."""
    turns = role("conversations")
    nodes = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("n"))
    name = lambda i: F.concat(F.lit("n"), i.cast("string"))
    node = lambda x, i: F.struct(
        name(i).alias("key"),
        F.struct(
            F.when(i > 0, name(i - 1)).alias("parent"),
            F.when(i < F.size("n") - 1, F.array(name(i + 1))).otherwise(F.array().cast("array<string>")).alias("children"),
            F.struct(F.struct(x["role"].alias("role")).alias("author"), F.struct(F.array(x["text"]).alias("parts")).alias("content")).alias("message"),
        ).alias("value"),
    )
    tree = F.struct(name(F.size("n") - 1).alias("current_node"), F.map_from_entries(F.transform("n", node)).alias("mapping"))
    files = nodes.select(F.col("conv_id").alias("id"), F.to_json(tree).alias("content"))
    return I.conversation_tree(files).select("id", F.col("position").cast("long").alias("position"), "role", "text")


@query("S14_memory_export", "SELECT p_partkey AS id, 'm' || p_partkey AS memory_id, p_name AS text, CASE p_partkey % 4 WHEN 0 THEN 'preference' WHEN 1 THEN 'goal' WHEN 2 THEN 'episodic' ELSE 'fact' END AS type, 6 AS importance FROM {part} WHERE length(trim(p_name)) >= 3")
def memory_export(role):
    i = F.col("p_partkey")
    category = F.get(F.array(*map(F.lit, ("Like", "objective", "EVENT", "other"))), (i % 4).cast("int"))
    memory = F.struct(F.concat(F.lit("m"), i.cast("string")).alias("id"), F.col("p_name").alias("memory"), F.array(category).alias("categories"))
    shape = F.when(i % 3 == 0, F.to_json(F.struct(F.array(memory).alias("memories")))).when(i % 3 == 1, F.to_json(F.struct(F.array(memory).alias("results")))).otherwise(F.to_json(F.array(memory)))
    return I.memory_export(role("part").select(i.alias("id"), shape.alias("content")))


@query("S15_memory_graph", "SELECT s_suppkey AS id, 'entity' AS kind, s_name || ' likes ' || CAST(s_nationkey AS VARCHAR) AS text FROM {supplier} UNION ALL SELECT s_suppkey, 'relation', s_name || ' is a member of ' || 'N' || s_nationkey FROM {supplier}")
def memory_graph(role):
    nation = F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))
    lines = [
        F.to_json(F.struct(F.lit("entity").alias("type"), F.col("s_name").alias("name"), F.array(F.lit("old news")).alias("observations"))),
        F.to_json(F.struct(F.lit("entity").alias("type"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("likes "), F.col("s_nationkey").cast("string"))).alias("observations"))),
        F.to_json(F.struct(F.lit("entity").alias("type"), nation.alias("name"), F.array().cast("array<string>").alias("observations"))),
        F.to_json(F.struct(F.lit("relation").alias("type"), F.col("s_name").alias("from"), nation.alias("to"), F.lit("MEMBER_OF").alias("relationType"))),
        F.to_json(F.struct(F.lit("relation").alias("type"), F.col("s_name").alias("from"), F.lit("nobody").alias("to"), F.lit("knows").alias("relationType"))),
    ]
    return I.graph_jsonl(role("supplier").select(F.col("s_suppkey").alias("id"), F.concat_ws("\n", *lines).alias("content")))


@query("S18_json_log", "SELECT user_id AS id, count(*) AS lines, count(*) FILTER (event_type = 'error') AS broken, sum(CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) ELSE 0 END)::BIGINT AS total FROM {events} GROUP BY 1")
def json_log(role):
    line = F.when(F.col("event_type") == "error", F.lit("not json")).otherwise(F.col("props"))
    files = role("events").groupBy(F.col("user_id").alias("id")).agg(F.array_join(F.collect_list(line), "\n").alias("content"))
    rows = I.json_log(files, "k long")
    return rows.groupBy("id").agg(F.count("*").alias("lines"), F.count_if("broken").alias("broken"), F.sum(F.coalesce("row.k", F.lit(0))).alias("total"))


@query("S8_activity_json", """SELECT event_id AS id, 0 AS record_no, event_type || ' ' || event_id AS prompt, event_type AS response, CAST(floor(epoch(ts)) AS BIGINT) AS secs FROM {events} WHERE event_id % 3 <> 0""")
def activity_json(role):
    """Each event as a file of one record; those of another product are left out."""
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    header = F.when(F.col("event_id") % 3 == 0, F.lit("Search")).when(F.col("event_id") % 3 == 1, F.lit("Gemini Apps"))
    html = F.array(F.struct(F.concat(F.lit("<p>"), "event_type", F.lit("</p> ")).alias("html")))
    title = F.concat(F.lit("Prompted "), "event_type", F.lit(" "), F.col("event_id").cast("string"))
    files = role("events").select(F.col("event_id").alias("id"), F.to_json(F.array(F.struct(header.alias("header"), title.alias("title"), at.alias("time"), html.alias("safeHtmlItem")))).alias("content"))
    return I.activity_json(files).withColumnRenamed("at", "secs")


@query("S9_activity_html", """SELECT event_id AS id, 1 AS cell_no, event_type || ' & ' || event_id AS prompt, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS secs FROM {events}""")
def activity_html(role):
    """Each event as a page with one prompted cell, every fifth without a date, and a cell of another kind."""
    at = F.when(F.col("event_id") % 5 == 0, F.lit("some day")).otherwise(F.date_format(F.col("ts").cast("timestamp"), "d MMM yyyy, HH:mm:ss"))
    cell = F.concat(F.lit('<html><div class="outer-cell">Prompted <b>'), "event_type", F.lit("</b> & "), F.col("event_id").cast("string"), F.lit("<br>"), at, F.lit(' UTC</div><div class="outer-cell">Used nothing</div></html>'))
    return I.activity_html(role("events").select(F.col("event_id").alias("id"), cell.alias("content"))).withColumnRenamed("at", "secs")
