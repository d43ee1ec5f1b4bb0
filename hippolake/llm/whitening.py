"""Whitening of embeddings along their leading principal components, found by LOBPCG.

Components become integers, floor(64 c) + 1000000, so that counts, sums and deviations are exact. The
fit list is each distinct integer vector once, written down. Its covariance V is never built: each
step of the solver asks for V B, for a block B of directions, which is one pass over the fit list,
centred row by row before anything is multiplied, summed per partition, then per dimension by a
shuffle. The driver holds blocks of `dimensions` rows and at most 3 * (k + GUARD) columns and no rows
of the table; it does the Rayleigh-Ritz step on the span of the iterate, its residuals and the
previous directions, until the residual of each component wanted is certified. A last pass measures
the covariance of the whitened fit list against the identity.

Defined results: rows whose vector is null or has a null or non-finite entry take no part. Neither
do vectors of another length than the most frequent among the distinct ones (ties: the longer). An
entry whose 64-fold is beyond 2^52 either way counts as that. Null ids and repeated ids are rows like others, and
repeated vectors get equal values. `deviation` is null where a long doesn't hold it. Where the
fit list spans fewer than k directions there are that many components (none for one vector, or for
copies of one); eigenvalues up to RANK of the largest count as rounding. Empty tables give no rows.
Other columns are ignored. Equal eigenvalues have no order, nor directions of their own, so any basis of theirs may come out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hippolake.storage import materialize

SCALE, SHIFT, MOST = 64, 1_000_000, float(1 << 52)
#: Columns of the solver's block beyond the components asked for.
GUARD = 8
#: A residual of at most CERTIFIED of its eigenvalue is enough, once steps no longer lower it; at FLOOR of the largest eigenvalue nothing is left to lower.
CERTIFIED, FLOOR, RANK = 1e-10, 1e-14, 1e-12
MOST_STEPS = 1000
#: Rows that are centred and multiplied at once.
ROWS = 4096


def to_integers(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x (array<long>) of the rows that take part, whatever their length."""
    v = F.col(vector_col)
    whole = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    held = lambda c: F.greatest(F.least(c.cast("double") * SCALE, F.lit(MOST)), F.lit(-MOST))
    return vectors.filter(whole).select(F.col(id_col).alias("vec_id"), F.transform(v, lambda c: F.floor(held(c)) + SHIFT).alias("x"))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


@dataclass(frozen=True)
class Centre:
    """Where the fit list's middle is: n vectors, their exact sums, as whole part and rest of sums / n."""

    n: int
    sums: tuple[int, ...]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in doubles; the large parts cancel as integers."""
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sum over dimensions of (n x - S)^2, per row."""
        near = x - self.whole
        most = (int(np.abs(near).max(initial=0)) + 1) * self.n
        if most * most * max(1, x.shape[1]) < 1 << 63:
            t = near * self.n - self.rest
            return np.einsum("ij,ij->i", t, t).tolist()
        t = near.astype(object) * self.n - self.rest.astype(object)
        return [s if s < 1 << 63 else None for s in (t * t).sum(axis=1)]


@dataclass(frozen=True)
class Whitening:
    """What fit() learned: vectors are columns, by falling eigenvalue."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def _add_up(fit: DataFrame, dimensions: int, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of fit of make(x), an array with the same shape for each block x of rows.

    Each partition hands on its own sum, cut into rows, and a group sums one such row over all
    partitions, in their order, so no task nor the driver sees more than its share of them.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch.column(0), dimensions)
            for at in range(0, len(x), ROWS):
                made = make(x[at : at + ROWS])
                total = made if total is None else total + made
        if total is not None:
            part = TaskContext.get().partitionId()
            rows = [row.tobytes() for row in total]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array(rows, pa.binary())], ["i", "part", "cells"])

    kind = make(np.zeros((0, dimensions), np.int64)).dtype

    def joined(group: pa.Table) -> pa.Table:
        rows = group.sort_by("part")["cells"].to_pylist()
        total = np.sum([np.frombuffer(r, kind) for r in rows], axis=0)
        return pa.table({"i": pa.array([group["i"][0].as_py()], pa.int32()), "cells": pa.array([total.astype(kind).tobytes()], pa.binary())})

    summed = fit.select("x").mapInArrow(partial, "i int, part int, cells binary").groupBy("i").applyInArrow(joined, "i int, cells binary").collect()
    if not summed:
        return make(np.zeros((0, dimensions), np.int64))
    return np.stack([np.frombuffer(r.cells, kind) for r in sorted(summed, key=lambda r: r.i)])


def _centre(fit: DataFrame, dimensions: int) -> Centre:
    """Exact count and sums. Entries are summed in two halves, so that longs hold the sums of 2^31 rows of any entries."""

    def halves(x: np.ndarray) -> np.ndarray:
        return np.stack([(x >> 31).sum(axis=0), (x & 0x7FFFFFFF).sum(axis=0), np.full(dimensions, len(x))], axis=1).astype(np.int64)

    high, low, n = _add_up(fit, dimensions, halves).T
    return Centre(int(n[0]), tuple((int(h) << 31) + int(w) for h, w in zip(high, low, strict=True)))


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the block's columns add to the orthonormal columns of `against`."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        block = block - against @ (against.T @ block)
        if not block.shape[1]:
            return block
        left, sizes, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, sizes > 1e-8]
    return block


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dimensions: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the k leading eigenpairs of the symmetric positive semidefinite V with product(B) = V B.

    A step costs one product, of the iterate, its residuals and the previous directions, made
    orthonormal. Products are taken anew for all three, so errors don't pile up from step to step.
    """
    width = min(dimensions, k + GUARD)
    k = min(k, dimensions)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, width)))[0]
    before = np.zeros((dimensions, 0))
    residual = before
    best, idle = np.inf, 0
    for _ in range(MOST_STEPS):
        basis = x
        for more in (residual, before):
            basis = np.hstack([basis, _orthonormal(more, basis)])
        applied = product(basis)
        small = basis.T @ applied
        values, rotation = np.linalg.eigh((small + small.T) / 2)
        values, rotation = values[::-1][:width], rotation[:, ::-1][:, :width]
        before = basis[:, width:] @ rotation[width:]
        x, ax = basis @ rotation, applied @ rotation
        residual = ax - x * values
        sizes = np.linalg.norm(residual[:, :k], axis=0)
        largest = max(float(values[0]), 0.0)
        real = values[:k] > RANK * largest
        worst = float((sizes / np.where(real, values[:k], np.inf)).max(initial=0.0)) if largest else 0.0
        best, idle = (worst, 0) if worst < best / 2 else (best, idle + 1)
        if not largest or (sizes <= FLOOR * dimensions * largest).all() or (worst <= CERTIFIED and idle >= 2):
            return values[:k][real], x[:, :k][:, real]
    raise RuntimeError(f"after {MOST_STEPS} steps a residual is {worst:.1e} of its eigenvalue")


def fit_vectors(rows: DataFrame) -> tuple[DataFrame, int]:
    """Each distinct x of rows (vec_id, x) once, written down, and the number of dimensions."""
    distinct = materialize(rows.select("x").distinct(), "fit")
    length = F.size("x").alias("length")
    most = distinct.groupBy(length).count().orderBy(F.desc("count"), F.desc("length")).first()
    dimensions = most["length"] if most else 0
    return distinct.filter(F.size("x") == dimensions), dimensions


def fit(rows: DataFrame, k: int = 16) -> Whitening | None:
    """The whitening of rows (vec_id, x), as to_integers gives them; None if there are none."""
    distinct, dimensions = fit_vectors(rows)
    if not dimensions:
        return None
    centre = _centre(distinct, dimensions)

    def moments(x: np.ndarray) -> np.ndarray:
        c = centre.centred(x)
        return np.stack([c.sum(axis=0), (c * c).sum(axis=0)], axis=1)

    left, squares = _add_up(distinct, dimensions, moments).T
    trace = float(squares.sum()) / centre.n

    def product(block: np.ndarray) -> np.ndarray:
        def times(x: np.ndarray) -> np.ndarray:
            c = centre.centred(x)
            return c.T @ (c @ block)

        return _add_up(distinct, dimensions, times) / centre.n

    values, vectors = lobpcg(product, dimensions, k)
    # Of either sign, the one whose largest entry is positive.
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], axis=0)[0] < 0, -1.0, 1.0)
    found = Whitening(centre, values, vectors, trace, 0.0)
    if not len(values):
        return found
    mean = _project(found, left / centre.n)

    def whitened(x: np.ndarray) -> np.ndarray:
        w = _project(found, centre.centred(x)) - mean
        return w.T @ w

    error = np.abs(_add_up(distinct, dimensions, whitened) / centre.n - np.eye(len(values))).max()
    return Whitening(centre, values, vectors, trace, float(error))


def _project(model: Whitening, centred: np.ndarray) -> np.ndarray:
    return centred @ model.vectors / np.sqrt(model.values)


def transform(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """One row per row of rows (vec_id, x) and component; the columns are those of the registered query."""
    id_type = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    dimensions, k = model.vectors.shape
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _matrix(part.column("x"), dimensions)
                m = len(x) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(m, model.centre.n)),
                        pa.array([d for d in model.centre.deviations(x) for _ in range(k)], pa.int64()),
                        pa.array(_project(model, model.centre.centred(x)).ravel()),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(m, model.identity_error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.filter(F.size("x") == dimensions).select("vec_id", "x").mapInArrow(run, schema)
