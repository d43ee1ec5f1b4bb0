"""Rolling metrics, histograms, rate limits and retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hippolake.functions.arrays import scan


def last_n(df: DataFrame, n: int, *, key: str, order: list[str]) -> DataFrame:
    return df.withColumn("age", F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(o) for o in order]))).filter(F.col("age") <= n).drop("age")


def rolling(samples: DataFrame, *, key: str, order: list[str], value: str, cap: float, n: int = 100, share: float = 0.95) -> DataFrame:
    """Mean, share at the cap and the share-quantile by position over each key's last n samples."""
    kept = last_n(samples, n, key=key, order=order)
    ordered = F.array_sort(F.collect_list(value))
    place = F.least(F.floor(F.count("*") * share), F.count("*") - 1).cast("int")
    return kept.groupBy(key).agg(F.avg(value).alias("mean"), F.avg((F.col(value) >= cap).cast("double")).alias("cap_rate"), F.get(ordered, place).alias("p95"), F.count("*").alias("samples"))


def histogram(df: DataFrame, value: str, bounds: list[float], *, key: str) -> DataFrame:
    """Cumulative counts at each bound, as a metrics endpoint exports them; the last bound takes all."""
    arms = F.array(*[F.struct(F.lit(float(b)).alias("le"), (F.col(value) <= b).cast("int").alias("hit")) for b in bounds], F.struct(F.lit(float("inf")).alias("le"), F.lit(1).alias("hit")))
    return df.select(key, F.inline(arms)).groupBy(key, "le").agg(F.sum("hit").alias("count"))


def rate_limit(hits: DataFrame, *, key: str, order: list[str], at: str, most: int, window: int) -> DataFrame:
    """hits with `allowed`: fewer than `most` allowed ones in the `window` seconds before. Denied hits don't count.

    The fold keeps a key's allowed times of the window, at most `most` of them, over its hits in order.
    """
    listed = hits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(at, *[c for c in order if c != at]))).alias("hits"))

    def step(before: Column, hit: Column) -> tuple[Column, Column]:
        recent = F.filter(before, lambda t: t > hit[at] - window)
        allowed = F.size(recent) < most
        return F.when(allowed, F.concat(recent, F.array(hit[at]))).otherwise(recent), F.struct(hit[order[-1]].alias(order[-1]), allowed.alias("allowed"))

    kinds = dict(hits.dtypes)
    none = F.array().cast(f"array<{kinds[at]}>")
    return listed.select(key, F.inline(scan(F.col("hits"), none, step, f"struct<{order[-1]}:{kinds[order[-1]]},allowed:boolean>")))


def nearest_ranks(asked: dict[str, tuple[str, float]]) -> list[Column]:
    """name: (column, share) -> aggregates of nearest-rank percentiles."""
    return [F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {column})").alias(name) for name, (column, share) in asked.items()]


def retrieval_quality(ranked: DataFrame, relevant: DataFrame, k: int, *, query: str = "query_id", item: str = "id", category: str = "category", tasks: int | None = None) -> DataFrame:
    """recall@k, precision@k and MRR by category and over all (category null), with the nearest-rank median and 95th percentile of recall and the median of reciprocal ranks.

    ranked has `rank`, relevant the category too. A nearest rank is the smallest value that so large a share of the queries don't exceed.
    tasks: over how many rows are dealt where they meet, if not over as many as the session says.
    """
    dealt = lambda df, *keys: df.repartition(tasks, *keys) if tasks else df
    relevant = dealt(relevant.select(query, item, category), query, item)
    expected = relevant.groupBy(query, category).agg(F.count("*").alias("expected"))
    hits = dealt(ranked.filter(F.col("rank") <= k).select(query, item, "rank"), query, item).join(relevant.select(query, item), [query, item], "left_semi")
    found = hits.groupBy(query).agg(F.count("*").alias("found"), F.min("rank").alias("first"))
    per = dealt(expected, query).join(dealt(found, query), query, "left").select(category, (F.coalesce("found", F.lit(0)) / F.col("expected")).alias("recall"), (F.coalesce("found", F.lit(0)) / k).alias("precision"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))
    return per.rollup(category).agg(F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), F.avg("rr").alias("mrr"), F.count("*").alias("queries"), *nearest_ranks({"recall_p50": ("recall", 0.5), "recall_p95": ("recall", 0.95), "rr_p50": ("rr", 0.5)}))
