"""Random-hyperplane buckets of vectors: planes derived from a secret, signatures, blind bucket names.

Each table's planes come from the secret alone, so every writer and every reader derives the same
ones and none is stored: HKDF-SHA256 gives bytes, Box-Muller makes normal weights of them. A vector's
side of each plane is a bit, a table's bits name its bucket, and the name's digest is what an index holds.
"""

from __future__ import annotations

import hashlib
import hmac
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLES, BITS = 20, 32
#: Names under which bytes are derived and buckets digested, and how many bytes one expansion gives at most.
TABLE_INFO, BLOCK_INFO, BUCKET_NAME = "lsh_table_{table}", "{info}_block_{block}", "lsh_t{table}_{bits}"
MOST_EXPANDED = 255 * 32


def _expand(key: bytes, info: bytes, length: int) -> bytes:
    """HKDF's second step (RFC 5869)."""
    out, last = b"", b""
    for counter in range(1, -(-length // 32) + 1):
        last = hmac.digest(key, last + info + bytes([counter]), "sha256")
        out += last
    return out[:length]


def extracted(secret: bytes) -> bytes:
    """HKDF's first step, without salt."""
    return hmac.digest(b"", secret, "sha256")


def derive_bytes(secret: bytes, info: str, length: int) -> bytes:
    """As many bytes as asked for, in expansions of their own names."""
    key, out = extracted(secret), b""
    for block in range(-(-length // MOST_EXPANDED)):
        out += _expand(key, BLOCK_INFO.format(info=info, block=block).encode(), min(MOST_EXPANDED, length - len(out)))
    return out


@lru_cache(maxsize=4)
def planes(secret: bytes, dims: int, tables: int = TABLES, bits: int = BITS) -> np.ndarray:
    """Normal weights, tables x bits x dims."""
    if len(secret) < 16 or min(dims, tables, bits) < 1:
        raise ValueError("a secret has 16 bytes at least; tables, bits and dimensions are positive")
    out = []
    for table in range(tables):
        raw = derive_bytes(secret, TABLE_INFO.format(table=table), dims * bits * 8)
        u = (np.frombuffer(raw, "<u4").astype(np.float64) + 1.0) / (0xFFFFFFFF + 2.0)
        out.append(np.sqrt(-2.0 * np.log(u[0::2])) * np.cos(2.0 * np.pi * u[1::2]))
    return np.stack(out).reshape(tables, bits, dims)


def signature(vector: Column, secret: bytes, dims: int, tables: int = TABLES, bits: int = BITS) -> Column:
    """array<long> of a vector's bits per table, the first plane's bit the highest; null for vectors of another length, or with nulls in them."""
    if bits > 62:
        raise ValueError("a signature has 62 bits at most")
    powers = (1 << np.arange(bits - 1, -1, -1)).astype(np.int64)

    @F.arrow_udf("array<long>")
    def signed(values):
        import pyarrow as pa
        import pyarrow.compute as pc

        fits = pc.fill_null(pc.equal(pc.list_value_length(values), dims), False)
        flat = values.filter(fits).flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
        gaps = pc.is_null(flat).to_numpy(zero_copy_only=False).reshape(-1, dims).any(axis=1)
        side = x @ planes(secret, dims, tables, bits).reshape(tables * bits, dims).T >= 0
        found = (side.reshape(len(x), tables, bits) * powers).sum(axis=2).tolist()
        known = iter([None if gap else row for row, gap in zip(found, gaps.tolist(), strict=True)])
        return pa.array([next(known) if ok else None for ok in fits.to_pylist()], pa.list_(pa.int64()))

    return signed(vector)


def bucket_hash(table: Column, bits_of: Column, bits: int = BITS) -> Column:
    """The digest under which a table's bucket stands in an index."""
    text = F.lpad(F.bin(bits_of), bits, "0")
    return F.sha2(F.concat(F.lit(BUCKET_NAME.split("{")[0]), table.cast("string"), F.lit("_"), text), 256)


def bucket_hashes(signatures: Column, bits: int = BITS) -> Column:
    """array<string>: a bucket's digest per table; empty for a null signature."""
    return F.coalesce(F.transform(signatures, lambda s, t: bucket_hash(t, s, bits)), F.array().cast("array<string>"))


def planes_sql(secret: bytes, dims: int, tables: int = TABLES, bits: int = BITS) -> str:
    """The planes for the comparison engine, which derives them itself: CTEs that end in planes(t, b, weights).

    HMAC is two digests over the key's pads, which are constants here.
    """
    pads = [bytes(b ^ x for b in extracted(secret).ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]
    floats = dims * bits
    blocks = -(-floats * 8 // MOST_EXPANDED)
    each = MOST_EXPANDED // 8
    step = lambda message: f"sha256(unhex('{pads[1]}' || sha256(unhex('{pads[0]}' || {message}))))"
    number = lambda at: f"CAST('0x' || h[{at} + 7:{at} + 8] || h[{at} + 5:{at} + 6] || h[{at} + 3:{at} + 4] || h[{at} + 1:{at} + 2] AS BIGINT)"
    return f"""
expanded(t, block, i, h) AS (
  SELECT t, block, 1, {step("hex(encode('lsh_table_' || t || '_block_' || block)) || '01'")} FROM range({tables}) a(t), range({blocks}) c(block)
  UNION ALL SELECT t, block, i + 1, {step("h || hex(encode('lsh_table_' || t || '_block_' || block)) || printf('%02x', i + 1)")} FROM expanded WHERE i < 255
), numbers AS (
  SELECT t, block * {each} + (i - 1) * 4 + w AS n, {number("w * 16")} AS one, {number("w * 16 + 8")} AS two FROM expanded, range(4) d(w)
), weights AS (
  SELECT t, n // {dims} AS b, n % {dims} AS d, sqrt(-2.0 * ln((one + 1) / 4294967297.0)) * cos(2.0 * pi() * (two + 1) / 4294967297.0) AS weight FROM numbers WHERE n < {floats}
), planes AS (
  SELECT t, b, list(weight ORDER BY d) AS weights FROM weights GROUP BY t, b
)"""


def near_pairs(vectors: DataFrame, least: float, secret: bytes, dims: int, *, id_col: str = "id", vector_col: str = "embedding", tables: int = TABLES, bits: int = BITS) -> DataFrame:
    """a, b, n_tables, cosine of distinct vectors that share a bucket in some table and have at least this cosine, a < b.

    Equal vectors share all buckets; the one with the smallest id stands for them, so a group of
    copies is one row. A pair that several tables find is made by the first of them: both signatures
    travel with the rows, so nothing needs to be made distinct. Vectors are joined to candidates only.
    A bucket that very many unlike vectors share is a skewed join, which adaptive execution splits.
    Vectors that are null, of another length or all zeros take no part.
    """
    from hippolake.functions.vectors import cosine, dot
    from hippolake.storage import materialize

    real = vectors.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) == dims)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter("id IS NOT NULL")
    one = real.groupBy("v").agg(F.min("id").alias("id")).filter(dot(F.col("v"), F.col("v")) > 0)
    one = materialize(one.select("id", "v", signature(F.col("v"), secret, dims, tables, bits).alias("signed")).filter("signed IS NOT NULL"), "signed")
    rows = one.select("id", "signed", F.posexplode("signed").alias("table", "bucket"))
    left, right = rows.alias("l"), rows.select(F.col("id").alias("other"), F.col("signed").alias("other_signed"), "table", "bucket").alias("r")
    shared = F.filter(F.transform("signed", lambda s, t: F.when(s == F.get("other_signed", t), t)), lambda t: t.isNotNull())
    met = left.join(right, (F.col("l.table") == F.col("r.table")) & (F.col("l.bucket") == F.col("r.bucket")) & (F.col("id") < F.col("other")))
    met = met.withColumn("shared", shared).filter(F.get("shared", F.lit(0)) == F.col("l.table")).select(F.col("id").alias("a"), F.col("other").alias("b"), F.size("shared").alias("n_tables"))
    pairs = met.join(one.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(one.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    return pairs.withColumn("cosine", F.round(cosine(F.col("va"), F.col("vb")), 12)).filter(F.col("cosine") >= least).select("a", "b", "n_tables", "cosine")
