"""Filter interaction audit: what five quality filters remove, alone and after each other, in every order.

Words are relations here: texts are exploded into one row a word, counted per (document, word), and
those counts summed per document, which gives each document's words and distinct words. The words of
a document all come from its own row, so both aggregations run where the row is read, as Arrow
tables; no word is shuffled. (As DataFrame aggregations, with texts dealt out by document first, it took
about 900 CPU seconds a GB on one machine.) The narrow rows are written down, the flags that need other rows
(copies of an earlier text, labels) are outer-joined to them, and each part (source) is aggregated
into one count per set of failed filters: 32 conditional counts for five filters, each over all
documents, the good ones and the toxic ones. Every figure of every order follows from those 96
columns, so the 120 orders cost nothing a document.

Defined results: a null text is an empty one. A null source and an empty one are the same part. A
document with a null id has no smaller id before it and isn't before any other, so it never fails E
and makes none fail. Rows that share an id are documents of their own; those that share a text too
don't fail E by each other. An id with several labels is good or toxic if any of them says so; null
labels say nothing. Other columns are ignored. An empty table gives no parts. Texts of any length are read whole.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hippolake.storage import materialize

FILTERS = "ABCDE"
#: Thresholds of A to D; shares are in hundredths.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 2, "[#$%&*|]"
#: Rows of one text meet its first id on so many keys; rows of one id are left to adaptive skew joins.
SALTS = 32
#: Characters of texts whose words are exploded at once, unless one text has more.
SLICE = 4_000_000


def count_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words and distinct words of each text (no nulls)."""
    words = pc.ascii_split_whitespace(texts)
    exploded = pa.table({"row": pc.list_parent_indices(words), "word": pc.list_flatten(words)})
    exploded = exploded.filter(pc.not_equal(exploded["word"], ""))
    per_word = exploded.group_by(["row", "word"], use_threads=False).aggregate([([], "count_all")])
    per_row = per_word.group_by("row", use_threads=False).aggregate([("count_all", "sum"), ([], "count_all")])
    counts = np.zeros((2, len(texts)), np.int64)
    at = per_row["row"].to_numpy()
    counts[0, at], counts[1, at] = per_row["count_all_sum"].to_numpy(), per_row["count_all"].to_numpy()
    return counts[0], counts[1]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
            part = batch.slice(at, upto - at)
            words, distinct = count_words(part.column("text"))
            kept = part.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(words), pa.array(distinct)], [*kept.schema.names, "words", "distinct_words"])
            at = upto


def own_flags(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, part, digest of its text, and the flags a to d, as integers."""
    text = F.coalesce("text", F.lit(""))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    read = docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"),
        (100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long")).cast("int").alias("c"),
        text.rlike(MARKS).cast("int").alias("d"), text.alias("text"),
    )
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read.schema if f.name != "text")
    counted = read.mapInArrow(_counted, f"{kept}, words long, distinct_words long")
    few = (F.col("words") < LEAST_WORDS).cast("int").alias("a")
    alike = (100 * F.col("distinct_words") < LEAST_DISTINCT * F.col("words")).cast("int").alias("b")
    return counted.select("doc_id", "part", "digest", few, alike, "c", "d")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, part, mask (bit i for the i-th of FILTERS it fails), good, toxic."""
    # The salt is written down with the row, so each reader finds the same one.
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    flags = materialize(own_flags(docs).withColumn("salt", salt), "flags")
    # Texts of one row, nearly all, have no earlier copy, so only the others' first ids are joined.
    firsts = flags.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1 AND first IS NOT NULL").drop("copies")
    salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    says = [F.max((F.col(c) == 1).cast("int")).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))]
    marked = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*says)
    joined = flags.join(salted, ["digest", "salt"], "left").join(marked, "doc_id", "left")
    e = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    mask = sum((b * (1 << i) for i, b in enumerate([F.col("b"), F.col("c"), F.col("d"), e], 1)), F.col("a"))
    return joined.select("doc_id", "part", mask.alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def counts_by_mask(documents: DataFrame) -> DataFrame:
    """One row per part: docs, good and toxic, each an array of 32 counts, by mask."""
    sets = range(1 << len(FILTERS))
    met = lambda also, m: F.count_if((F.col("mask") == m) & also)
    columns = [met(also, m).alias(f"{name}_{m}") for name, also in (("docs", F.lit(True)), ("good", F.col("good") == 1), ("toxic", F.col("toxic") == 1)) for m in sets]
    counted = documents.groupBy("part").agg(*columns)
    return counted.select("part", *[F.array(*[F.col(f"{name}_{m}") for m in sets]).alias(name) for name in ("docs", "good", "toxic")])


def _orders() -> Column:
    """Every step of every order: its name, place, filter's bit and the bits before it."""
    steps = []
    for order in permutations(FILTERS):
        bits = [1 << FILTERS.index(name) for name in order]
        steps += [{"filter_order": "".join(order), "step": i + 1, "bit": bit, "before": sum(bits[:i])} for i, bit in enumerate(bits)]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step; the columns are those of the registered query."""
    steps = counts_by_mask(judged(docs, labels)).withColumn("at", F.explode(_orders())).select("part", "docs", "good", "toxic", "at.*")
    bit, before = F.col("bit"), F.col("before")
    masks = F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))

    def total(counts: str, keep) -> Column:
        taken = F.transform(masks, lambda m: F.when(keep(m), F.element_at(F.col(counts), m + 1)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(taken, F.lit(0).cast("long"), lambda a, x: a + x)

    fails = lambda m: m.bitwiseAND(bit) != 0
    passed = lambda m: m.bitwiseAND(before) == 0
    here = lambda m: fails(m) & passed(m)
    # Of the orders, one in as many as a document has failures sees this filter first.
    orders = F.lit(math.factorial(len(FILTERS)))
    share = F.transform(masks, lambda m: F.when(fails(m), F.element_at(F.col("docs"), m + 1) * (orders / F.bit_count(m)).cast("long")).otherwise(F.lit(0).cast("long")))
    return steps.select(
        "part", "filter_order", "step",
        total("docs", lambda m: passed(m) & ~fails(m)).alias("kept"),
        total("docs", here).alias("removed"),
        total("docs", lambda m: fails(m) & ~passed(m)).alias("redundant"),
        total("docs", lambda m: m == bit).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("long"), lambda a, x: a + x).alias("shapley"),
    )
