"""SimHash fingerprints, in DataFrame operations only.

The terms of a text are its pairs of neighbouring words, A-Z lowered, each as often as it occurs;
a text of one word has that word. Every term's 128-bit hash votes on every bit; a bit is set if more
than half of the weight votes for it. Votes are counted two to a 64-bit sum (bits k and k + 32 of a
hash), so that a text of any length below 2**32 terms is counted exactly in 64 sums.

near_pairs finds all fingerprints within a Hamming radius by permuted block tables: with two blocks
more than the radius, two fingerprints that near agree on at least two blocks, so there is a table for
each two blocks, in which they lead.
"""

from __future__ import annotations

import json
import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hippolake.functions.arrays import once
from hippolake.llm.text import BLANK, BLANKS, ascii_lower
from hippolake.storage import materialize

BITS = 128
_LANES = 0x0000000100000001
#: Rows of a stretch of ids, and the most stretches, about; with more rows stretches grow.
STRETCH_ROWS, MOST_STRETCHES = 500, 16_384
#: Bits within which two fingerprints count as near: texts of a hundred words differ by more once a word of them is changed.
NEAR_BITS = 3


def terms(text: Column) -> Column:
    """array<long>: hashes of the neighbouring pairs of words; of the word if there is one; empty if none."""
    clean = F.trim(ascii_lower(text), F.lit(BLANKS))  # an expression anchored at the end would try each blank of an inner run as a start
    words = F.split(clean, BLANK, -1)
    pairs = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 2, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))
    held = F.transform(F.array(words), pairs)  # the words are split once, not at each use
    return F.when(clean == "", F.array().cast("array<bigint>")).otherwise(F.element_at(held, 1))


def votes(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the two halves `high`, `low` of the fingerprint of each row's text.

    keys tell the rows apart. Where texts is already dealt by one of the keys, nothing is shuffled.
    """
    each = texts.select(*keys, F.explode_outer(terms(F.col("text"))).alias("h0")).withColumn("h1", F.when(F.col("h0").isNotNull(), F.xxhash64("h0", F.lit(1))))
    sums = [F.sum(F.shiftright(h, k).bitwiseAND(F.lit(_LANES))).alias(f"{h}_{k}") for h in ("h0", "h1") for k in range(32)]
    counted = each.groupBy(*keys).agg(F.count("h0").alias("n"), *sums)

    def half(h: str) -> Column:
        bits = []
        for k in range(32):
            both = F.coalesce(F.col(f"{h}_{k}"), F.lit(0))
            for count, place in ((both.bitwiseAND(F.lit(0xFFFFFFFF)), k), (F.shiftrightunsigned(both, 32), k + 32)):
                bits.append(F.when(2 * count > F.col("n"), F.lit(1 << place if place < 63 else -(1 << 63))).otherwise(F.lit(0)))
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    return counted.select(*keys, half("h0").alias("high"), half("h1").alias("low"))


def as_text(high: Column, low: Column) -> Column:
    """32 hexadecimal digits, lower case."""
    return F.lower(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in (high, low)]))


def likeness(high: Column, low: Column, other_high: Column, other_low: Column) -> Column:
    """Share of equal bits."""
    return 1 - (F.bit_count(high.bitwiseXOR(other_high)) + F.bit_count(low.bitwiseXOR(other_low))) / float(BITS)


def stretch_of(doc_id: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are at most doc_id; 0 for null. Found in two steps, in an array of arrays."""
    if not cuts:
        return F.lit(0)
    fan = math.isqrt(len(cuts)) + 1
    pages = [cuts[i : i + fan] for i in range(0, len(cuts), fan)]
    held = F.from_json(F.lit(json.dumps(pages)), "array<array<bigint>>")
    heads = F.from_json(F.lit(json.dumps([p[0] for p in pages])), "array<bigint>")
    upto = lambda cuts_: F.size(F.filter(cuts_, lambda c: c <= doc_id))
    return F.when(doc_id.isNull() | (doc_id < cuts[0]), 0).otherwise(once(upto(heads), lambda page: (page - 1) * fan + upto(F.get(held, page - 1))))


def with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: int = 4, radius: int = NEAR_BITS) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document's text, and their likeness.

    The edited text: the last floor(n / share) characters replaced by as many first ones of the next
    document (or all it has), in ascending order of id; after the last comes the first. Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and
    n_near: how many other fingerprints of the table are at most `radius` bits from the document's.

    Null texts are empty; texts without words have the fingerprint 0. Texts of any length are read
    whole, their terms counted as a stream. Null ids come first, equal ids are ordered by text; a
    single document is its own next; an empty table gives no rows. Extra columns are not read.

    Documents are dealt to stretches of ids by approximate quantiles, one row each to the next one's
    stretch, so that only the text itself is shuffled, once. Rows of one id lie in one stretch.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    stretches = min(MOST_STRETCHES, 1 + rows.count() // STRETCH_ROWS)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / stretches for i in range(1, stretches)] or [0.5], max(10_000, 4 * stretches))).first()[0] if stretches > 1 else []
    dealt = rows.withColumn("stretch", stretch_of(F.col("doc_id"), sorted(set(cuts or []))))

    # The first text of the following stretch, for the last row of each; one row per stretch. Only stretch numbers are lined up.
    firsts = dealt.groupBy("stretch").agg(F.min_by("text", F.struct("doc_id", "text")).alias("first_text"))
    line = W.orderBy("stretch")
    around = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    followers = dealt.select("stretch").distinct().select(F.col("stretch").alias("of"), F.coalesce(F.lead("stretch").over(line), F.first("stretch").over(around)).alias("stretch"))
    firsts = followers.join(firsts, "stretch").select("of", "first_text")

    order = W.partitionBy("stretch").orderBy("doc_id", "text")
    placed = dealt.withColumn("place", F.row_number().over(order)).withColumn("following", F.lead("text").over(order)).withColumn("last", F.lead(F.lit(True)).over(order).isNull())
    placed = placed.join(firsts, (F.col("stretch") == F.col("of")) & F.col("last"), "left")
    n = F.length("text")
    cut = F.floor(n / share).cast("int")
    after = F.when(F.col("last"), F.col("first_text")).otherwise(F.col("following"))
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr(after, F.lit(1), cut))
    one = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    # kind 2, the next text itself, is only needed where the next row is in another stretch.
    variants = F.array_compact(F.array(one(0, F.col("text")), one(1, edited), F.when(F.col("last"), one(2, F.col("first_text")))))
    each = placed.select("stretch", "place", "doc_id", n.cast("long").alias("n_chars"), F.explode(variants).alias("v"))
    each = each.select("stretch", "place", "doc_id", "n_chars", "v.kind", "v.text", F.when(F.col("v.kind") == 1, F.sha2("v.text", 256)).alias("sha"))
    keys = ["stretch", "place", "doc_id", "n_chars", "kind", "sha"]
    marked = votes(each, keys)
    pick = lambda column, kind: F.max(F.when(F.col("kind") == kind, F.col(column)))
    wide = marked.groupBy("stretch", "place", "doc_id", "n_chars").agg(F.max("sha").alias("edited_sha256"), *[pick(c, k).alias(f"{c}{k}") for c in ("high", "low") for k in (0, 1, 2)])
    along = W.partitionBy("stretch").orderBy("place")
    following = [F.coalesce(f"{c}2", F.lead(f"{c}0").over(along)).alias(f"next_{c}") for c in ("high", "low")]
    wide = wide.select("*", *following)
    wide = materialize(wide, "marks")
    near = near_counts(wide.select(F.col("high0").alias("high"), F.col("low0").alias("low")), radius)
    wide = wide.join(near, (F.col("high0") == near["high"]) & (F.col("low0") == near["low"]), "left").drop(near["high"], near["low"])
    own, changed, other = (F.col("high0"), F.col("low0")), (F.col("high1"), F.col("low1")), (F.col("next_high"), F.col("next_low"))
    return wide.select("doc_id", "n_chars", "edited_sha256", as_text(*own).alias("fingerprint"), as_text(*changed).alias("edited_fingerprint"), likeness(*own, *changed).alias("near_edited"), likeness(*own, *other).alias("near_next"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def fingerprints(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """text_key (md5), high, low of each distinct text; null is empty."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_key", F.md5("text"))
    return votes(texts.groupBy("text_key").agg(F.first("text").alias("text")), ["text_key"])


def _block(high: Column, low: Column, b: int, width: int) -> list[Column]:
    """The bits of block b that lie in each of the two words."""
    start, end = b * width, min(BITS, (b + 1) * width)
    parts = []
    for word, base in ((high, 0), (low, 64)):
        first, last = max(start, base), min(end, base + 64)
        if first < last:
            mask = ((1 << (last - base)) - 1) & ~((1 << (first - base)) - 1)
            parts.append(word.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
        else:
            parts.append(F.lit(0).cast("long"))
    return parts


def near_pairs(marks: DataFrame, radius: int = NEAR_BITS) -> DataFrame:
    """All pairs of different fingerprints at most `radius` bits apart: high, low, other_high, other_low, distance.

    marks: rows with high and low, repeated as often as they may be; equal fingerprints are taken
    once, so a group of copies is one row. Pairs come once, the smaller (high, low) first.
    The bits are cut into radius + 2 blocks, of which two such fingerprints share two at least. Each
    two blocks lead one table, which is joined on them (about two fifths of the bits at radius 3, so
    that strangers hardly meet); a pair found in several tables is reported by the first. A lead that
    very many share is a skewed join, which adaptive execution splits. Null rows take no part; an
    empty table gives no rows.
    """
    distinct = marks.select("high", "low").dropna().distinct()
    blocks = radius + 2
    width = -(-BITS // blocks)
    tables = list(combinations(range(blocks), 2))

    def lead(high: Column, low: Column, table: tuple[int, int]) -> list[Column]:
        """The two blocks' bits, which don't overlap, in one pair of words."""
        one, two = (_block(high, low, b, width) for b in table)
        return [one[0].bitwiseOR(two[0]), one[1].bitwiseOR(two[1])]

    entries = F.array(*[F.struct(F.lit(i).alias("table"), *[x.alias(n) for x, n in zip(lead(F.col("high"), F.col("low"), t), ("a", "b"), strict=True)]) for i, t in enumerate(tables)])
    led = distinct.select("high", "low", F.explode(entries).alias("t")).select("high", "low", "t.*")
    left, right = led.alias("l"), led.select(F.col("high").alias("other_high"), F.col("low").alias("other_low"), "table", "a", "b").alias("r")
    after = (F.col("high") < F.col("other_high")) | ((F.col("high") == F.col("other_high")) & (F.col("low") < F.col("other_low")))
    distance = F.bit_count(F.col("high").bitwiseXOR(F.col("other_high"))) + F.bit_count(F.col("low").bitwiseXOR(F.col("other_low")))
    met = left.join(right, (F.col("l.table") == F.col("r.table")) & (F.col("l.a") == F.col("r.a")) & (F.col("l.b") == F.col("r.b")) & after & (distance <= radius))
    apart = [reduce(Column.bitwiseOR, (x.bitwiseXOR(y) for x, y in zip(_block(F.col("high"), F.col("low"), b, width), _block(F.col("other_high"), F.col("other_low"), b, width), strict=True))) for b in range(blocks)]
    # The first table whose two blocks agree: the two first blocks that do.
    agree = F.filter(F.array(*[F.when(x == 0, F.lit(b)) for b, x in enumerate(apart)]), lambda b: b.isNotNull())
    first = F.create_map(*[x for i, t in enumerate(tables) for x in (F.lit(t[0] * blocks + t[1]), F.lit(i))])
    return met.filter(F.col("l.table") == first[F.get(agree, 0) * blocks + F.get(agree, 1)]).select("high", "low", "other_high", "other_low", distance.alias("distance"))


def near_counts(marks: DataFrame, radius: int = NEAR_BITS) -> DataFrame:
    """high, low, n_near of the fingerprints that have others within the radius."""
    pairs = near_pairs(marks, radius)
    ends = F.explode(F.array(F.struct("high", "low"), F.struct(F.col("other_high").alias("high"), F.col("other_low").alias("low")))).alias("e")
    return pairs.select(ends).groupBy("e.high", "e.low").agg(F.count("*").alias("n_near"))
