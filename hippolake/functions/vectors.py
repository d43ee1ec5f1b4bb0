"""Column functions over vectors, and pairs of similar ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 for missing or empty vectors, different lengths and zero norms."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(usable & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


#: Rows of a block whose pairs are multiplied at once, components of a part at most, and parts that make enough tasks of a table.
BLOCK_ROWS, PART_COMPONENTS, ENOUGH_PARTS = 1024, 1 << 20, 12
#: Rows that a task is dealt, and pairs that it puts out or looks at by name at once.
TASK_ROWS, SOME_PAIRS = 1 << 16, 1 << 16


def _first_shared(tags: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows a and b (places in tags, codes padded with -1): how many of b's codes a has too, and the first of those."""
    shared = ((tags[b][:, :, None] == tags[a][:, None, :]) & (tags[b] >= 0)[:, :, None]).any(axis=2)
    return shared.sum(axis=1), tags[b, shared.argmax(axis=1)]


def cosine_pairs(vectors: DataFrame, least: float, *, id_col: str, vector_col: str, block: str | None = None, blocks: str | None = None) -> DataFrame:
    """a, b[, block][, n_shared], cosine: every pair of ids a < b, of one block if given, with at least this cosine (above 0, rounded to 12 places).

    blocks: a column with the names of all blocks of the row's id, distinct and in order, where an id stands in several. A pair then comes once,
    under the first of b's that a has too, with their number, which the task that finds it sees.

    A block's rows are dealt to parts, and each two parts meet in one group and are multiplied there, tile by tile, so a hot
    block is many tasks'; blocks of one part share groups. A row goes to as many groups as its block has parts, so parts are as large as a task
    may hold; tasks are as many as rows ask for, and pairs leave them tile by tile. That is all
    pairs of a block, so it is for blocks, or for thresholds at which buckets don't narrow the search.
    Rows without id, block or vector take no part.
    """
    name = F.col(block) if block else F.lit(0)
    all_names = [F.col(blocks).alias("tags")] if blocks else []
    rows = vectors.filter(F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & name.isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), name.alias("block"), F.size(vector_col).alias("dims"), *all_names)
    counted = rows.groupBy("block", "dims").agg(F.count("*").alias("n"))
    total = rows.count()
    of_part = F.greatest(F.lit(BLOCK_ROWS), F.least(F.floor(PART_COMPONENTS / F.col("dims")), F.lit(total // ENOUGH_PARTS)))
    sizes = counted.withColumn("parts", (1 + F.floor((F.col("n") - 1) / of_part)).cast("int"))
    groups = max(1, -(-total // BLOCK_ROWS))
    dealt = sizes.agg(F.sum(F.col("n") * F.col("parts"))).first()[0] or 0
    tasks = max(vectors.sparkSession.sparkContext.defaultParallelism, min(groups * ENOUGH_PARTS, -(-dealt // TASK_ROWS)))
    met = rows.join(sizes.drop("n"), ["block", "dims"])
    met = met.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumn("bin", F.when(F.col("parts") > 1, F.xxhash64("block")).otherwise(F.pmod(F.xxhash64("block"), F.lit(groups))))
    met = met.select("id", "v", "dims", "block", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "bin", *(["tags"] if blocks else []))
    kind = dict(met.dtypes)["block"]

    def products(x: np.ndarray, left: np.ndarray, right: np.ndarray):
        for at in range(0, len(left), BLOCK_ROWS):
            for to in range(0, len(right), 2 * BLOCK_ROWS):
                some, others = left[at : at + BLOCK_ROWS], right[to : to + 2 * BLOCK_ROWS]
                cosines = x[some] @ x[others].T
                i, j = np.nonzero(cosines >= least - 1e-11)
                c = cosines[i, j].round(12)
                kept = c >= least
                yield some[i[kept]], others[j[kept]], c[kept]

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        table = pa.Table.from_batches(list(batches))
        dims, _, p, q = (k.as_py() for k in key)
        ids, part = table.column("id").to_numpy(), table.column("part").to_numpy()
        codes = table.column("block").combine_chunks().dictionary_encode()
        codes = codes if isinstance(codes, pa.DictionaryArray) else codes.combine_chunks()
        of_block, names = codes.indices.to_numpy(), codes.dictionary
        x = pc.list_flatten(table.column("v").combine_chunks()).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        if blocks:
            listed = table.column("tags").combine_chunks()
            listed = listed if isinstance(listed, pa.Array) else listed.chunk(0)
            flat, lengths = pc.dictionary_encode(pc.list_flatten(listed)), pc.list_value_length(listed).to_numpy()
            tags = np.full((len(ids), max(1, int(lengths.max()))), -1, np.int64)
            tags[np.arange(tags.shape[1])[None, :] < lengths[:, None]] = flat.indices.to_numpy()
            code_of = pc.index_in(names, flat.dictionary).to_numpy(zero_copy_only=False)
        order = np.argsort(of_block, kind="stable")
        edges = [0, *(np.flatnonzero(np.diff(of_block[order])) + 1).tolist(), len(order)]
        held, n_held = [], 0

        def out():
            a, b, of, n, c = (np.concatenate([h[i] for h in held]) for i in range(5))
            columns = {"a": a, "b": b, "block": names.take(pa.array(of.astype(np.int32))), **({"n_shared": n} if blocks else {}), "cosine": c}
            return pa.RecordBatch.from_pydict(columns)

        for low, high in zip(edges, edges[1:], strict=False):
            inside = order[low:high]
            of = of_block[inside[0]] if len(inside) else 0
            for i, j, c in products(x, inside[part[inside] == p], inside[part[inside] == q]):
                kept = ids[i] < ids[j] if p == q else ids[i] != ids[j]
                i, j, c = i[kept], j[kept], c[kept]
                i, j = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
                step = max(1, min(SOME_PAIRS, (1 << 24) // tags.shape[1] ** 2)) if blocks else SOME_PAIRS
                for at in range(0, len(i), step):
                    a, b, some = i[at : at + step], j[at : at + step], c[at : at + step]
                    n = np.ones(len(a), np.int64)
                    if blocks:
                        n, first = _first_shared(tags, a, b)
                        own = first == code_of[of]
                        a, b, some, n = a[own], b[own], some[own], n[own]
                    held.append((ids[a], ids[b], np.full(len(a), of), n, some))
                    n_held += len(a)
                    if n_held >= SOME_PAIRS:
                        yield out()
                        held, n_held = [], 0
        if n_held:
            yield out()

    shared = "n_shared long, " if blocks else ""
    found = met.repartition(tasks, "dims", "bin", "p", "q").groupBy("dims", "bin", "p", "q").applyInArrow(run, f"a long, b long, block {kind}, {shared}cosine double")
    return found.withColumnRenamed("block", block) if block else found.drop("block")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_similarity(distance: Column, bits: int) -> Column:
    """The cosine that a Hamming distance between hyperplane signatures suggests."""
    return F.cos(F.lit(float(np.pi)) * distance / bits)


def cosine_hits(queries: DataFrame, vectors: DataFrame, least: float, *, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """query_id, id: each vector but the query's own with at least this cosine (rounded to 12 places) to each query: the plain answer that indexes are measured by.

    Queries are dealt to blocks of about BLOCK_ROWS, and each block meets each part of the vectors in a
    task, as one matrix product. Vectors of one length only; nulls and zero vectors hit nothing.
    """
    real = lambda df: df.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    asked, rows = real(queries), real(vectors)
    blocks, parts = 1 + asked.count() // BLOCK_ROWS, 1 + rows.count() // (8 * BLOCK_ROWS)
    kind = dict(asked.dtypes)["id"]
    left = asked.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    right = rows.select("id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int").alias("part"))

    def meet(q, d):
        import pyarrow as pa

        if not q.num_rows or not d.num_rows:
            return pa.table({"query_id": pa.array([], q.schema.field("id").type), "id": pa.array([], d.schema.field("id").type)})
        a, b = (np.stack([np.asarray(v.as_py(), np.float64) for v in t["v"].combine_chunks()]) for t in (q, d))
        norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            near = (np.round(a @ b.T / norms, 12) >= least) & (norms > 0)
        ids, others = q["id"].to_numpy(), d["id"].to_numpy()
        i, j = np.nonzero(near & (ids[:, None] != others[None, :]))
        return pa.table({"query_id": pa.array(ids[i]), "id": pa.array(others[j])})

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(meet, f"query_id {kind}, id {kind}")
