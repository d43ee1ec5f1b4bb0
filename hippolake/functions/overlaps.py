"""Sets of numbers that hold a share of others: what a task does with a part of the stored sets and the new ones that pass by.

A set is a list of elements, ascending from the rarest to the commonest, with weights, and further ones (`words`) of which each
belongs to an element. An element's weight is how many of the set's entries it stands for: itself and its words. So what two sets share is at
most the weight of the elements that they share, and a set's size is the sum of its weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bits of a set's marks. Entries that meet at once, pairs that are counted at once, and pairs that are counted whatever they can share. Bits of a bound in a key.
MARK_BITS, SOME_MET, SOME_PAIRS, FEW_PAIRS, BOUND_BITS = 512, 1 << 20, 1 << 16, 1 << 13, 20
MOST_BOUND = (1 << BOUND_BITS) - 1


@dataclass(frozen=True)
class Part:
    """Stored sets in order of their ids, and the entries of which a set that holds its share of one has at least one."""

    ids: np.ndarray
    sizes: np.ndarray
    needed: np.ndarray
    #: How many marks a set may lack, and its elements of weight 1.
    lacking: np.ndarray
    light: np.ndarray
    marks: np.ndarray
    #: All numbers of the part; elsewhere their places in it stand for them.
    universe: np.ndarray
    #: Where each number's entries start; an entry is its number and what its set needs (keys), and its set (sets).
    starts: np.ndarray
    keys: np.ndarray
    sets: np.ndarray
    #: All numbers of each set.
    every: np.ndarray
    bounds: np.ndarray


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The elements of a column of lists, and the row of each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)


def _rest(weights: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The weight of each element and those behind it in its row."""
    rest = np.cumsum(sizes)[rows]
    rest -= np.cumsum(weights, dtype=np.int64)
    rest += weights
    return rest


def _marks(numbers: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """(n, words): a bit for each number that falls into it."""
    bit = ((numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MARK_BITS.bit_length() + 1)).astype(np.int64)
    out = np.empty((n, MARK_BITS // 64), np.uint64)
    edges = np.searchsorted(rows, np.arange(0, n + 8192, 8192))
    for k, at in enumerate(range(0, n, 8192)):
        some = np.zeros((min(8192, n - at), MARK_BITS), bool)
        some[rows[edges[k] : edges[k + 1]] - at, bit[edges[k] : edges[k + 1]]] = True
        out[at : at + 8192] = np.packbits(some, axis=1).view(np.uint64)
    return out


def _bits(words: np.ndarray) -> np.ndarray:
    """How many bits each row of MARK_BITS has."""
    x = np.bitwise_count(words).view(np.uint64)[:, 0]  # eight words, so eight counts
    low = np.uint64(0x00FF00FF00FF00FF)
    return (((x & low) + ((x >> np.uint64(8)) & low)) * np.uint64(0x0001000100010001)) >> np.uint64(48)


def _stretches(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of all stretches, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def needed_of(sizes: np.ndarray, least: float) -> np.ndarray:
    """The fewest entries that are more than this share."""
    return np.floor(sizes * least + 1e-9).astype(np.int64) + 1


def part_of(stored: pa.Table, least: float) -> Part:
    """stored: id, hashes, weights, words. The driver holds it, so places and rows are 32 bits wide and what isn't needed any more goes."""
    stored = stored.sort_by("id")
    ids, n = stored["id"].to_numpy(), len(stored)
    (elements, rows), (words, of_words) = _flat(stored["hashes"]), _flat(stored["words"])
    weights = _flat(stored["weights"])[0]
    del stored
    sizes = np.bincount(rows, weights, n).astype(np.int64)
    needed = needed_of(sizes, least)
    light = np.bincount(rows, weights == 1, n).astype(np.int64)
    # Who shares more than the share has one of the elements behind which less than the share is left.
    first = _rest(weights, rows, sizes) >= needed[rows]
    universe = np.unique(np.concatenate([np.unique(elements), np.unique(words)]))
    places, word_places = (np.searchsorted(universe, x).astype(np.int32) for x in (elements, words))
    del elements, words, weights
    n_elements, n_words = np.bincount(rows, minlength=n), np.bincount(of_words, minlength=n)
    bounds = np.concatenate([[0], np.cumsum(n_elements + n_words)])
    every = np.empty(bounds[-1], np.int32)
    every[_stretches(bounds[:-1], n_elements)] = places
    every[_stretches(bounds[:-1] + n_elements, n_words)] = word_places
    del word_places, of_words
    marks = _marks(places, rows, n)
    keys = (places[first].astype(np.int64) << BOUND_BITS) | np.minimum(needed[rows[first]], MOST_BOUND)
    order = np.argsort(keys, kind="stable")
    sets, keys = rows[first][order], keys[order]
    # Missing elements weigh 1 at least, and 2 but for those of weight 1.
    lacking = np.minimum(sizes - needed, (sizes - needed + light) // 2).astype(np.uint64)
    return Part(ids, sizes, needed, lacking, light, marks, universe, np.searchsorted(keys, np.arange(len(universe)) << BOUND_BITS), keys, sets, every, bounds)


def _known(universe: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers' places, and whether they are there."""
    places = np.minimum(np.searchsorted(universe, numbers), max(0, len(universe) - 1))
    return places, (universe[places] == numbers) if len(universe) else np.zeros(len(numbers), bool)


def holders(part: Part, new: pa.RecordBatch | pa.Table, least: float, most: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """row of new, old_id, shared, size: new sets that hold more than `least` of a stored one with a smaller id; where they are many, each new set's `most` best.

    floor: the share of each new set beyond which alone a stored one counts, since `most` others with smaller ids have as much.
    """
    ids, n = new["id"].to_numpy(zero_copy_only=False) if isinstance(new, pa.RecordBatch) else new["id"].to_numpy(), len(new)
    (elements, rows), (words, of_words) = _flat(new["hashes"]), _flat(new["words"])
    rows, of_words, weights = rows.astype(np.int64), of_words.astype(np.int64), _flat(new["weights"])[0]
    rest = _rest(weights, rows, np.bincount(rows, weights, n).astype(np.int64))
    places, known = _known(part.universe, elements)
    places, rows, rest = places[known], rows[known], rest[known]
    word_places, word_known = _known(part.universe, words)
    lacks = ~_marks(places, rows, n)
    earlier = np.searchsorted(part.ids, ids)
    # If this is the first element that both have, no more can be shared than the new set's weight from here on.
    starts = part.starts[places]
    lengths = np.searchsorted(part.keys, (places << BOUND_BITS) | np.minimum(rest, MOST_BOUND), side="right") - starts
    lengths[earlier[rows] == 0] = 0
    met = np.cumsum(np.bincount(rows, lengths, n).astype(np.int64))
    owned = np.concatenate([rows * len(part.universe) + places, of_words[word_known] * len(part.universe) + word_places[word_known]])
    owned.sort()

    def count(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """Those pairs that share enough, and how many entries."""
        out = [(a[:0], b[:0], np.zeros(0, np.int64))]
        for at in range(0, len(a), SOME_PAIRS):
            x, y = a[at : at + SOME_PAIRS], b[at : at + SOME_PAIRS]
            entries = part.bounds[y + 1] - part.bounds[y]
            asked = np.repeat(x * len(part.universe), entries) + part.every[_stretches(part.bounds[y], entries)]
            near = slice(*np.searchsorted(owned, [x.min() * len(part.universe), (x.max() + 1) * len(part.universe)]))
            shared = np.bincount(np.repeat(np.arange(len(x)), entries), _known(owned[near], asked)[1], len(x)).astype(np.int64)
            kept = shared / np.maximum(part.sizes[y], 1) > least
            out.append((x[kept], y[kept], shared[kept]))
        return tuple(np.concatenate(column) for column in zip(*out, strict=True))

    found, n_found, low = [], 0, 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(met, (met[low - 1] if low else 0) + SOME_MET, side="right")))
        some = slice(*np.searchsorted(rows, [low, high]))
        a, b = np.repeat(rows[some], lengths[some]), part.sets.take(_stretches(starts[some], lengths[some]))
        low = high
        kept = np.flatnonzero(b < earlier.take(a))
        a, b = a.take(kept), b.take(kept)
        missing = _bits(part.marks.take(b, axis=0) & lacks.take(a, axis=0))
        kept = missing <= part.lacking.take(b)
        pairs, at = np.unique(a[kept] * len(part.ids) + b[kept], return_index=True)
        a, b, missing = pairs // len(part.ids), pairs % len(part.ids), missing[kept][at].astype(np.int64)
        bound = (part.sizes[b] - np.maximum(missing, 2 * missing - part.light[b])) / np.maximum(part.sizes[b], 1)
        if floor is not None:
            kept = bound > floor[a]
            a, b, bound = a[kept], b[kept], bound[kept]
        if len(a) > FEW_PAIRS:
            # Those that can share most come first; the others are counted where they can still be among the best.
            order = np.lexsort((b, -bound, a))
            a, b, bound = a[order], b[order], bound[order]
            early = np.arange(len(a)) - np.searchsorted(a, a) < 2 * most
            x, y, shared = _best(part, *count(a[early], b[early]), most)
            last = np.flatnonzero(np.arange(len(x)) - np.searchsorted(x, x) == most - 1)
            share, tie = np.full(n, -1.0), np.full(n, -1)
            share[x[last]], tie[x[last]] = (shared / np.maximum(part.sizes[y], 1))[last], y[last]
            late = ~early & ((bound > share[a]) | ((bound == share[a]) & (b < tie[a])))
            found.append((x, y, shared))
            a, b = a[late], b[late]
        found.append(count(a, b))
        n_found += sum(len(x[0]) for x in found[-2:])
        if n_found > SOME_PAIRS:
            found = [_best(part, *(np.concatenate(x) for x in zip(*found, strict=True)), most)]
            n_found = len(found[0][0])
    a, b, shared = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    return a, part.ids[b], shared, part.sizes[b]


def _best(part: Part, a: np.ndarray, b: np.ndarray, shared: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """The `most` pairs of each a with the largest share, ties by id."""
    order = np.lexsort((b, -(shared / np.maximum(part.sizes[b], 1)), a))
    a, b, shared = a[order], b[order], shared[order]
    kept = np.arange(len(a)) - np.searchsorted(a, a) < most
    return a[kept], b[kept], shared[kept]


def _merged(part: Part, new: pa.RecordBatch, least: float, most: int) -> tuple[np.ndarray, ...]:
    """row, old_id, shared, size: what new sets bring with them from earlier parts (if they do), and what they have in this one."""
    if "olds" not in new.schema.names:
        return holders(part, new, least, most)
    (olds, rows), shared, sizes = _flat(new["olds"]), _flat(new["shared"])[0], _flat(new["sizes"])[0]
    share = shared / np.maximum(sizes, 1)
    full, floor = np.bincount(rows, minlength=len(new)) >= most, np.ones(len(new))
    np.minimum.at(floor, rows, share)
    found = holders(part, new, least, most, np.where(full, floor, -1.0))
    rows, olds, shared, sizes = (np.concatenate(x) for x in zip((rows, olds, shared, sizes), found, strict=True))
    order = np.lexsort((olds, -(shared / np.maximum(sizes, 1)), rows))
    rows, olds, shared, sizes = rows[order], olds[order], shared[order], sizes[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < most
    return rows[kept], olds[kept], shared[kept], sizes[kept]


def meeting(part, least: float, most: int):
    """What mapInArrow calls with sets (id, hashes, weights, words[, olds, shared, sizes]): (new_id, old_id, shared, size). part: the broadcast Part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, *columns = _merged(part.value, batch, least, most)
            ids = batch["id"].to_numpy(zero_copy_only=False)[row]
            yield pa.RecordBatch.from_pydict(dict(zip(("new_id", "old_id", "shared", "size"), (pa.array(c, pa.int64()) for c in (ids, *columns)), strict=True)))

    return run


def carrying(part, least: float, most: int):
    """What mapInArrow calls with sets (id, hashes, weights, words, olds, shared, sizes): the same sets with the `most` best that they have had so far. part: the broadcast Part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, *columns = _merged(part.value, batch, least, most)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(batch)))]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(c, pa.int64())) for c in columns]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("id", "hashes", "weights", "words")), *lists], ["id", "hashes", "weights", "words", "olds", "shared", "sizes"])

    return run
