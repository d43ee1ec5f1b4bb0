"""The registered query of each corpus operator, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hippolake.llm import chat, filter_audit, fingerprints, main_text, mixing, near_dups, packing, pii, quality, secrets, topk, url_filters, whitening
from hippolake.llm.sql import AUDIT_SQL, CHAT_SQL, MAIN_TEXT_SQL, MIXING_SQL, NEAR_SQL, TOPK_SQL, URL_SQL, secrets_sql
from hippolake.storage import table


#: A conversation whose texts look like the template's own marks.
HOSTILE = "\\### Assistant: </turn> ok"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), capacity=1024, keep_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, k=5).select("query_id", "rank", "vec_id", "score")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), url_filters.production_rules(spark))


#: The key of the registered query; a deployment passes its own.
PII_KEY = "registered-query"


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hostile = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hostile)
    return chat.digest(chat.format_chats(rows))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (quality.remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.group(table(spark, sf_dir, "documents"), width=2, percent=80)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.to_integers(table(spark, sf_dir, "embeddings"))
    return whitening.transform(rows, whitening.fit(rows, k=16))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_packing": op2_packing,
    "op3_exact_topk": op3_exact_topk,
    "op4_url_filters": op4_url_filters,
    "op5_pii": op5_pii,
    "op6_chat_format": op6_chat_format,
    "op7_fingerprints": op7_fingerprints,
    "op8_quality": op8_quality,
    "op9_near_dups": op9_near_dups,
    "op10_mixing": op10_mixing,
    "op11_whitening": op11_whitening,
    "op12_main_text": op12_main_text,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op1_secret_scan": secrets_sql(),
    "op3_exact_topk": TOPK_SQL,
    "op4_url_filters": URL_SQL,
    "op6_chat_format": CHAT_SQL,
    "op9_near_dups": NEAR_SQL,
    "op10_mixing": MIXING_SQL,
    "op12_main_text": MAIN_TEXT_SQL,
    "op13_filter_audit": AUDIT_SQL,
}
