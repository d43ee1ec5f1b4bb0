"""The corpus pipeline: quality, near-duplicates, secrets, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver writes it as Parquet and
hands it to the next one. All but the last return the columns of docs, under their names and in their
order, whatever other columns there are. Null and empty texts, null and repeated ids, repeated rows and
very long texts pass each stage as its operator's docstring says; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hippolake.llm import mixing, near_dups, packing, quality, secrets
from hippolake.storage import materialize, table

#: Documents with at least this score are kept.
QUALITY_LEAST = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows, takes for good ones."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=docs.columns)
    return scored.filter(F.col("score") >= QUALITY_LEAST).select("row.*")


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Documents without words stay, as do unlike ones that share an id."""
    return near_dups.deduplicate(docs, width=5, percent=80)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark, n_chars as it is then; null texts stay null."""
    scanned = secrets.scan(docs, keep=docs.columns).withColumn("clean", secrets.redact(F.col("text"), F.col("spans")))
    changed = F.size("spans") > 0
    new = {"text": F.when(changed, F.col("clean")).otherwise(F.col("row.text")), "n_chars": F.when(changed, F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))}
    return scanned.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it was drawn, by output shard."""
    planned = mixing.plan(docs, payload=docs.columns)
    return mixing.emit(planned).select("payload.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, with their sequence and place in it."""
    return packing.pack(docs, capacity=1024, keep_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dups", near_dup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't say the trained, hashed and packed stages; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written down before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
