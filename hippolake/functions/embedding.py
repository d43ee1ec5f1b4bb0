"""Embeddings as text, and ids from names."""

from __future__ import annotations

import base64
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import Column

# Vectors of this length are written as 16-bit floats, others as 32-bit ones, and the namespace of session ids.
HALF_DIMS = 640
SESSION_NAMESPACE = "b7f3c2a4-0e5d-4a6b-9c1f-2d3e4f5a6b7c"


def encode_vector(values: np.ndarray) -> str:
    """Little-endian floats in base64; not for components that aren't finite, or that 16 bits can't hold."""
    half = len(values) == HALF_DIMS
    if not np.isfinite(values).all() or (half and (np.abs(values) > np.finfo(np.float16).max).any()):
        raise ValueError("a component of the vector can't be written")
    return base64.b64encode(values.astype("<f2" if half else "<f4").tobytes()).decode()


def decode_vector(text: str) -> np.ndarray:
    """What encode_vector or a JSON array says; a length that is neither is an error, never a vector of other dimensions."""
    text = text.strip()
    if text.startswith("["):
        return np.asarray(json.loads(text), np.float32)
    data = base64.b64decode(text, validate=True)
    if len(data) == 2 * HALF_DIMS:
        return np.frombuffer(data, "<f2").astype(np.float32)
    if len(data) % 4:
        raise ValueError(f"{len(data)} bytes are no vector")
    return np.frombuffer(data, "<f4")


def encoded(vectors: Column) -> Column:
    """Text of array<float>, an Arrow batch at a time; null stays null."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else encode_vector(np.asarray(v, np.float32)) for v in (x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in values)], pa.string())

    return run(vectors)


def decoded(texts: Column) -> Column:
    """array<float> of text; null stays null."""

    @F.arrow_udf("array<float>")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if not x.is_valid else decode_vector(x.as_py()) for x in values], pa.list_(pa.float32()))

    return run(texts)


def uuid5(name: Column, namespace: str = SESSION_NAMESPACE) -> Column:
    """The version 5 UUID of a name: digits of a SHA-1, with the version and the variant put in."""
    digest = F.sha1(F.concat(F.lit(bytes.fromhex(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
