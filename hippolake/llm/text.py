"""Words and their hashes, shared by the corpus operators."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: space and the ASCII control blanks, nothing else.
BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, every other character as it is."""
    return F.translate(text, _UPPER, _LOWER)


def word_count(text: Column) -> Column:
    """Number of words; null and blank texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class WordHashes(dict):
    """64-bit hash of a word, computed once per distinct word and process; bounded by `limit` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One per process, whichever operators run in it.
WORD_HASHES = WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; bytes.split and bytes.lower know exactly the ASCII blanks and letters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, over an array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of the runs of `width` words, sorted; fewer words make one run of them all."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    runs = max(1, n - width + 1)
    taken = min(n, width)
    acc = np.full(runs, np.uint64(taken))
    for i in range(taken):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + word_hashes[i : i + runs])
    return np.unique(acc)
