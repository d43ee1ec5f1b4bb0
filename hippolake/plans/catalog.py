"""Registry of the queries over the standard tables, with the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hippolake.storage import TABLES, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register fn(role) under name; role(view) gives a view of ROLES as a DataFrame over the tables at hand."""

    def register(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda view: role(spark, sf_dir, view))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_roles(sql)
        return fn

    return register


#: Views that give the standard tables the parts of a memory store. Each is SQL that both engines read;
#: names in braces are tables or other views.
ROLES = {
    # Facts without vectors are a view by themselves: a join that brings nothing more would still move every text.
    "fact_rows": """
        SELECT d.doc_id AS id, d.text, d.lang, d.n_chars, d.doc_id % 7 AS owner,
               CASE CAST(replace(d.source, 'src', '') AS INT) % 5 WHEN 0 THEN 'user' WHEN 1 THEN 'user-inferred' WHEN 2 THEN 'assistant' WHEN 3 THEN 'external' ELSE 'derived' END AS source,
               CAST(d.n_chars % 1000 AS DOUBLE) / 1000 AS decay_score, CAST(d.doc_id % 10 + 1 AS DOUBLE) / 10 AS importance,
               1700000000 + d.doc_id * 3600 AS created_at
        FROM {documents} d""",
    "facts": "SELECT f.*, e.embedding, e.label FROM {fact_rows} f LEFT JOIN {embeddings} e ON f.id = e.vec_id",
    "asked": "SELECT b.item_id AS query_id, b.text, e.embedding FROM {benchmark} b LEFT JOIN {embeddings} e ON b.item_id = e.vec_id",
    "stored": """
        SELECT o_orderkey AS id, o_custkey AS user_id, o_totalprice AS price, o_orderdate AS created_at, o_orderpriority AS source,
               CAST(o_orderkey % 100 AS DOUBLE) / 100 AS decay_score, o_orderkey % 11 <> 0 AS is_active, o_orderkey % 5 + 1 AS version,
               CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderkey END AS sequence_id,
               concat(CAST(o_custkey % 50 AS VARCHAR(20)), '-', CAST(o_orderkey % 9 AS VARCHAR(20))) AS content_fp
        FROM {orders}""",
    "log": """
        SELECT event_id, ts, user_id AS fact_id, event_type, value, CAST(floor(value) AS BIGINT) % 100 AS points, user_id % 5 AS owner
        FROM {events}""",
    "turns": "SELECT conv_id, turn, role, text, conv_id * 7200 + turn * (600 + 500 * (turn % 4)) AS secs FROM {conversations}",
    "claims": """
        SELECT d.doc_id AS id, d.text, e.label AS entity, e.embedding, CAST(d.doc_id % 10 + 1 AS INT) AS importance,
               CAST(d.doc_id % 11 AS DOUBLE) / 10 AS confidence, CAST(d.doc_id % 13 AS INT) AS corroboration,
               CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE CAST(d.doc_id % 90 AS DOUBLE) END AS age_days,
               CASE d.doc_id % 3 WHEN 0 THEN 'explicit' WHEN 1 THEN 'inferred' ELSE 'none' END AS validation,
               d.doc_id % 19 = 0 AS pinned, d.doc_id % 7 AS owner, d.source, 1700000000 + d.doc_id * 5000 AS created_at
        FROM {documents} d JOIN {embeddings} e ON d.doc_id = e.vec_id""",
}


def role(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    if view in TABLES:
        return table(spark, sf_dir, view)
    text = ROLES[view]
    parts = {name: role(spark, sf_dir, name) for name in (*TABLES, *ROLES) if "{" + name + "}" in text}
    return spark.sql(text, **parts)


def with_roles(sql: str) -> str:
    """sql with the views it names put before it."""
    needed: list[str] = []
    for view in reversed(ROLES):  # a view names only views before it
        if any("{" + view + "}" in text for text in (sql, *(ROLES[n] for n in needed))):
            needed.insert(0, view)
    plain = lambda s: s.format(**{n: n for n in (*TABLES, *ROLES)})
    views = [f"{v} AS ({plain(ROLES[v])})" for v in needed]
    for name in (*TABLES, *ROLES):
        sql = sql.replace("{" + name + "}", name)
    if not views:
        return sql
    recursive = "WITH RECURSIVE " if sql.lstrip().upper().startswith("WITH RECURSIVE") else "WITH "
    body = sql.lstrip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return recursive + ", ".join(views) + ", " + body[len(start) :]
    return recursive + ", ".join(views) + " " + body
