"""Scans, deltas and writes of a fact store, for all owners at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hippolake.functions.arrays import scan


def export_active(facts: DataFrame) -> DataFrame:
    return facts.filter("is_active")


def keyset_page(facts: DataFrame, limit: int, cursor: tuple | None = None, *, user_col: str = "user_id") -> DataFrame:
    """The first page after cursor = (created_at, id) of every user, newest first, with has_more.

    One row more than asked for is looked at, as a page by itself would. No cursor: the first page.
    """
    rows = facts.filter("is_active")
    if cursor is not None:
        at, last = F.lit(cursor[0]).cast("timestamp"), F.lit(cursor[1])
        rows = rows.filter((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < last)))
    per = W.partitionBy(user_col)
    rows = rows.withColumn("place", F.row_number().over(per.orderBy(F.desc("created_at"), F.desc("id")))).filter(F.col("place") <= limit + 1)
    return rows.withColumn("has_more", F.max("place").over(per) > limit).filter(F.col("place") <= limit)


def keyset_pages(facts: DataFrame, asked: DataFrame, limit: int, *, user_col: str = "user_id") -> DataFrame:
    """A page of each request: user, request columns, page (array<struct<id, created_at>>, newest first), next_cursor, has_more, total_count.

    asked: user and cursor, the id of the last fact of the page before; null asks for the first page. total_count is the number of the
    user's active facts, whatever the page. A cursor that isn't an active fact of that user gives an empty page. One
    fact more than asked for is looked at, as a request by itself would; a user's facts are never one task's list.
    """
    active = facts.filter("is_active").select(user_col, "id", "created_at")
    totals = active.groupBy(user_col).agg(F.count("*").alias("total_count"))
    at = active.select(F.col(user_col), F.col("id").alias("cursor"), F.col("created_at").alias("cursor_at"))
    requests = asked.select(user_col, "cursor").distinct().join(at, [user_col, "cursor"], "left")
    usable = requests.filter("cursor IS NULL OR cursor_at IS NOT NULL")
    after = F.col("cursor").isNull() | (F.col("created_at") < F.col("cursor_at")) | ((F.col("created_at") == F.col("cursor_at")) & (F.col("id") < F.col("cursor")))
    per = W.partitionBy(user_col, "cursor").orderBy(F.desc("created_at"), F.desc("id"))
    rows = usable.join(active, user_col).filter(after).withColumn("place", F.row_number().over(per)).filter(F.col("place") <= limit + 1)
    one = F.struct("place", "id", "created_at")
    pages = rows.groupBy(user_col, "cursor").agg(F.sort_array(F.collect_list(F.when(F.col("place") <= limit, one))).alias("listed"), (F.max("place") > limit).alias("has_more"))
    found = requests.select(user_col, "cursor").join(pages.withColumnsRenamed({user_col: "page_user", "cursor": "page_cursor"}), F.col(user_col).eqNullSafe(F.col("page_user")) & F.col("cursor").eqNullSafe(F.col("page_cursor")), "left").join(totals, user_col, "left")
    page = F.transform(F.coalesce("listed", F.array().cast(pages.schema["listed"].dataType)), lambda x: F.struct(x["id"].alias("id"), x["created_at"].alias("created_at")))
    more = F.coalesce("has_more", F.lit(False))
    return found.select(user_col, "cursor", page.alias("page"), more.alias("has_more"), F.when(more, F.get("listed", F.size("listed") - 1)["id"]).alias("next_cursor"), F.coalesce("total_count", F.lit(0)).cast("long").alias("total_count"))


def delta(facts: DataFrame, since: int, limit: int, *, user_col: str = "user_id") -> DataFrame:
    """Rows after a sequence number, by sequence with those that have none last; since 0 asks for all."""
    rows = facts if since == 0 else facts.filter(F.col("sequence_id") > since)
    order = W.partitionBy(user_col).orderBy(F.asc_nulls_last("sequence_id"), "id")
    latest = F.max("sequence_id").over(W.partitionBy(user_col))
    return rows.withColumn("latest", latest).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def store_once(incoming: DataFrame, stored: DataFrame, *, user_col: str = "user_id", fingerprint: str = "content_fp", order: str = "id") -> DataFrame:
    """incoming with `stored`: false where an active row, or an earlier incoming one, has the user's fingerprint."""
    known = stored.filter("is_active").select(user_col, fingerprint).distinct().withColumn("known", F.lit(True))
    first = F.row_number().over(W.partitionBy(user_col, fingerprint).orderBy(order)) == 1
    out = incoming.withColumn("first", first).join(known, [user_col, fingerprint], "left")
    return out.withColumn("stored", F.col("known").isNull() & F.col("first")).drop("known", "first")


def replay(log: DataFrame, *, id_col: str = "fact_id", order: list[str], threshold: float = 0.3) -> DataFrame:
    """The last writer's row per id, its sequence number, how often it was written, and whether it is active."""
    sequenced = log.withColumn("last", F.struct(*order, *[c for c in log.columns if c not in order and c != id_col]))
    state = sequenced.groupBy(id_col).agg(F.max("last").alias("last"), F.count("*").alias("writes"))
    return state.select(id_col, "last.*", "writes").withColumn("is_active", F.col("decay_score") >= threshold)


def sequence(df: DataFrame, order: list[str], *, name: str = "seq", spread: int | None = None) -> DataFrame:
    """Numbers rows from 1 in a total order, without one task seeing all of them.

    Rows are dealt by ranges of the order, numbered within each, and moved by what the ranges before hold.
    """
    from hippolake.storage import materialize

    parts = spread or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    counts = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    local = F.row_number().over(W.partitionBy("part").orderBy(*order))
    return dealt.withColumn("local", local).join(F.broadcast(counts), "part").withColumn(name, F.col("first") + F.col("local")).drop("part", "first", "local")


def update_if(facts: DataFrame, updates: DataFrame, *, key: str = "id") -> DataFrame:
    """facts after (key, expected, price): taken where the version is the expected one; applied is null without update."""
    met = facts.join(updates, key, "left")
    taken = F.col("expected") == F.col("version")
    return met.withColumn("applied", taken).withColumn("price", F.when(taken, F.col("new_price")).otherwise(F.col("price"))).withColumn("version", F.when(taken, F.col("version") + 1).otherwise(F.col("version"))).drop("expected", "new_price")


def tombstone(facts: DataFrame, deleted: DataFrame, *, key: str = "id") -> DataFrame:
    """facts with the deleted ones inactive."""
    gone = deleted.select(key).distinct().withColumn("gone", F.lit(True))
    return facts.join(gone, key, "left").withColumn("is_active", F.col("is_active") & F.col("gone").isNull()).drop("gone")


def batches(rows: DataFrame, *, key: str, order: str, size: str, most_rows: int, most_bytes: int) -> DataFrame:
    """Greedy batches per key: a row opens the next one when the count or the bytes would pass their limit.

    The fold runs inside one aggregate over a key's rows in order; a key's rows are one import's.
    """
    listed = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, size))).alias("rows"))

    def step(acc: Column, row: Column) -> tuple[Column, Column]:
        opens = (acc["n"] >= most_rows) | ((acc["n"] > 0) & (acc["bytes"] + row[size] > most_bytes))
        batch = acc["batch"] + F.when(opens, 1).otherwise(0)
        state = F.struct(batch.alias("batch"), F.when(opens, 1).otherwise(acc["n"] + 1).alias("n"), F.when(opens, row[size]).otherwise(acc["bytes"] + row[size]).alias("bytes"))
        return state, F.struct(row[order].alias(order), row[size].alias(size), batch.alias("batch"))

    kinds = dict(rows.dtypes)
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0).cast(kinds[size]).alias("bytes"))
    return listed.select(key, F.inline(scan(F.col("rows"), start, step, f"struct<{order}:{kinds[order]},{size}:{kinds[size]},batch:int>")))


def keep_newest(log: DataFrame, most: int, *, key: str, order: list[str]) -> DataFrame:
    """The newest `most` rows per key."""
    return log.withColumn("age", F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(o) for o in order]))).filter(F.col("age") <= most).drop("age")
