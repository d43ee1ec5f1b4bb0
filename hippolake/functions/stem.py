"""English stems by suffix stripping, as SQL expressions over a table of words.

The same text serves Spark and the comparison engine: it asks for `left`, `right`, `length` and a
regular expression only. A y that is a consonant is written Y meanwhile, so that character classes
tell vowels from consonants. Stems are made for a vocabulary, not for each occurrence of a word. Where texts' stems are only
counted, the task that reads them makes its own vocabulary's (`n_terms`), so that no word is shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOWEL, CONSONANT = "[aeiouy]", "[^aeiouy]"
#: What the measure of a stem (its runs of vowels and consonants) is asked to be.
ANY_RUN = f"^{CONSONANT}*{VOWEL}+{CONSONANT}"
TWO_RUNS = f"^{CONSONANT}*{VOWEL}+{CONSONANT}+{VOWEL}+{CONSONANT}"
ONE_RUN = f"^{CONSONANT}*{VOWEL}+{CONSONANT}+{VOWEL}*$"
SHORT = f"{CONSONANT}{VOWEL}[^aeiouywxY]$"

# The suffixes of the published algorithm of 1980, and what stands for them.
PLURALS = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
DOUBLE_SUFFIXES = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
SINGLE_SUFFIXES = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
LAST_SUFFIXES = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _strip(suffixes: dict[str, str], condition: Callable[[str], str]) -> str:
    """The first suffix in order that the word w has is replaced, if what stands before it satisfies the condition."""
    cases = []
    for suffix, other in suffixes.items():
        stem = f"left(w, length(w) - {len(suffix)})"
        cases.append(f"WHEN right(w, {len(suffix)}) = '{suffix}' THEN CASE WHEN {condition(stem)} THEN concat({stem}, '{other}') ELSE w END")
    return f"CASE {' '.join(cases)} ELSE w END"


def steps(matches: str) -> list[str]:
    """Expressions over w, each over what the one before it gives. matches: the name of the function that looks for an expression in a text."""
    has = lambda text, pattern: f"{matches}({text}, '{pattern}')"
    double = "length(w) > 2 AND right(w, 1) = substr(w, length(w) - 1, 1)"
    verb = {s: "+" for s in ("ed", "ing")}  # the plus says that the next step is to mend the end
    dropped = f"CASE WHEN right(w, 3) = 'eed' THEN CASE WHEN {has('left(w, length(w) - 3)', ANY_RUN)} THEN left(w, length(w) - 1) ELSE w END ELSE {_strip(verb, lambda stem: has(stem, VOWEL))} END"
    bare = "left(w, length(w) - 1)"
    before = "substr(w, length(w) - 1, 1)"
    mended = (
        f"CASE WHEN right(w, 1) <> '+' THEN w WHEN right(w, 3) IN ('at+', 'bl+', 'iz+') THEN concat({bare}, 'e')"
        f" WHEN length(w) > 2 AND {before} = substr(w, length(w) - 2, 1) AND {has('w', '[^aeiouylsz][+]$')} THEN left(w, length(w) - 2)"
        f" WHEN {has(bare, ONE_RUN)} AND {has(bare, SHORT)} THEN concat({bare}, 'e') ELSE {bare} END"
    )
    stem = "left(w, length(w) - 1)"
    return [
        _strip(PLURALS, lambda stem: "true"),
        dropped,
        mended,
        f"CASE WHEN right(w, 1) IN ('y', 'Y') AND {has(stem, VOWEL)} THEN concat({stem}, 'i') ELSE w END",
        _strip(DOUBLE_SUFFIXES, lambda stem: has(stem, ANY_RUN)),
        _strip(SINGLE_SUFFIXES, lambda stem: has(stem, ANY_RUN)),
        _strip(dict.fromkeys(LAST_SUFFIXES, ""), lambda stem: f"{has(stem, TWO_RUNS)} AND (right(w, 3) <> 'ion' OR right({stem}, 1) IN ('s', 't'))"),
        f"CASE WHEN right(w, 1) = 'e' AND ({has(stem, TWO_RUNS)} OR ({has(stem, ONE_RUN)} AND NOT {has(stem, SHORT)})) THEN {stem} ELSE w END",
        f"CASE WHEN right(w, 2) = 'll' AND {double} AND {has('w', TWO_RUNS)} THEN {stem} ELSE w END",
    ]


#: Only words of more than two of these letters have another stem than themselves.
STEMMED = "^[a-z][a-z][a-z]+$"


def with_stems(words: DataFrame, word_col: str = "token") -> DataFrame:
    """words with `stem`; give it distinct words."""
    out = f"regexp_replace(regexp_replace({word_col}, '^y', 'Y'), '([aeiouy])y', '$1Y')"
    for step in steps("regexp_like"):  # each step's word is bound once, not written out wherever the step uses it
        out = f"element_at(transform(array({out}), w -> {step}), 1)"
    return words.withColumn("stem", F.expr(f"CASE WHEN regexp_like({word_col}, '{STEMMED}') THEN lower({out}) ELSE {word_col} END"))


def stems_sql(words: str, word_col: str = "token") -> str:
    """SELECT of a word and its stem, for the comparison engine; words: a table with a column of distinct words."""
    sql = f"SELECT {word_col}, CASE WHEN regexp_matches({word_col}, '{STEMMED}') THEN regexp_replace(regexp_replace({word_col}, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') END AS w FROM {words}"
    for step in steps("regexp_matches"):
        sql = f"SELECT {word_col}, {step} AS w FROM ({sql})"
    return f"SELECT {word_col}, coalesce(lower(w), {word_col}) AS stem FROM ({sql})"


def _stripped(w: str, suffixes: dict[str, str], condition: Callable[[str], bool]) -> str:
    """_strip, of one word."""
    for suffix, other in suffixes.items():
        if w.endswith(suffix):
            stem = w[: len(w) - len(suffix)]
            return stem + other if condition(stem) else w
    return w


_any_run, _two_runs, _one_run, _short, _vowel, _stemmed = (re.compile(p).search for p in (ANY_RUN, TWO_RUNS, ONE_RUN, SHORT, VOWEL, STEMMED))
#: A word with none of these endings goes through all steps unchanged.
_ENDINGS = tuple({"y", "e", "ll", "ed", "ing", *PLURALS, *DOUBLE_SUFFIXES, *SINGLE_SUFFIXES, *LAST_SUFFIXES})
_LAST = dict.fromkeys(LAST_SUFFIXES, "")
_doubled = re.compile(r"([^aeiouylsz])\1[+]$").search


@lru_cache(maxsize=1 << 17)
def stem_of(word: str) -> str:
    """The stem of one word: the steps above, in their order."""
    if not word.endswith(_ENDINGS) or not _stemmed(word):
        return word
    w = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word))
    w = _stripped(w, PLURALS, lambda stem: True)
    if w.endswith("eed"):
        w = w[:-1] if _any_run(w[:-3]) else w
    else:
        w = _stripped(w, {"ed": "+", "ing": "+"}, _vowel)
    if w.endswith("+"):
        bare = w[:-1]
        if bare.endswith(("at", "bl", "iz")) or (not _doubled(w) and _one_run(bare) and _short(bare)):
            w = bare + "e"
        else:
            w = w[:-2] if _doubled(w) else bare
    if w.endswith(("y", "Y")) and _vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _stripped(w, DOUBLE_SUFFIXES, _any_run)
    w = _stripped(w, SINGLE_SUFFIXES, _any_run)
    before = w
    w = _stripped(w, _LAST, lambda stem: _two_runs(stem) and (not before.endswith("ion") or stem.endswith(("s", "t"))))
    if w.endswith("e") and (_two_runs(w[:-1]) or (_one_run(w[:-1]) and not _short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and len(w) > 2 and _two_runs(w):
        w = w[:-1]
    return w.lower()


def n_terms(words: Column) -> Column:
    """How many terms an array of distinct words has: the words and their distinct stems of two bytes at least. Each distinct word of a batch is stemmed once."""

    @F.arrow_udf("long")
    def counted(lists):
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        stems = pa.array([stem_of(w) for w in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
        stem_of_word = stems.indices.to_numpy(zero_copy_only=False)
        long = pc.greater_equal(pc.binary_length(stems.dictionary), 2).to_numpy(zero_copy_only=False)
        met = np.bincount(stem_of_word, minlength=len(long)) > 1
        row, stem = np.repeat(np.arange(len(sizes)), sizes), stem_of_word[coded.indices.to_numpy(zero_copy_only=False)]
        # Only a stem that several words of the batch have can be twice in a row.
        several, alone = (long & met)[stem], (long & ~met)[stem]
        once = np.unique(row[several] * max(1, len(long)) + stem[several]) // max(1, len(long))
        return pa.array(sizes + np.bincount(row[alone], minlength=len(sizes)) + np.bincount(once, minlength=len(sizes)), pa.int64())

    return counted(words)


#: What stands for a term: a place in the order of rarity for the commonest, a place of its own for those whose digests are alike, a digest for the others, which come first.
DIGESTS, LEAST_CODE = (1 << 31) - (1 << 20), -(1 << 31)


def term_of(word: str) -> str:
    """The term of a word's stem, or the word itself if its stem has less than two bytes. No word has a colon."""
    stem = stem_of(word)
    return "stem:" + stem if len(stem.encode()) >= 2 else word


def digests_of(terms: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(t.encode()) % DIGESTS for t in terms), np.int64, len(terms))


@dataclass(frozen=True)
class Codes:
    """digests and codes: of the common terms, in order of the digests. own: codes of terms by name."""

    digests: np.ndarray
    codes: np.ndarray
    own: dict[str, int]

    def of(self, terms: list[str]) -> np.ndarray:
        digests = digests_of(terms)
        at = np.minimum(np.searchsorted(self.digests, digests), max(0, len(self.digests) - 1))
        codes = digests + LEAST_CODE
        if len(self.digests):
            codes = np.where(self.digests[at] == digests, self.codes[at], codes)
        if self.own:
            for i, t in enumerate(terms):
                if t in self.own:
                    codes[i] = self.own[t]
        return codes


def codes_for(common: list[str], alike: list[str]) -> Codes:
    """common: the commonest terms, the commonest first. alike: all terms whose digest another one has too."""
    place = {t: len(common) - 1 - i for i, t in enumerate(common)}
    own = {t: place.get(t, -1 - i) for i, t in enumerate(alike)}
    rest = [t for t in common if t not in own]
    digests, codes = digests_of(rest), np.array([place[t] for t in rest], np.int64)
    order = np.argsort(digests)
    return Codes(digests[order], codes[order], own)


def counted_terms(batches):
    """What mapInArrow calls with (token, n): (term, digest, n) of the word and of its stem."""
    for batch in batches:
        words, n = batch.column(0).to_pylist(), batch.column(1)
        of_stems = [term_of(w) for w in words]
        for terms, kept in ((words, [True] * len(words)), (of_stems, [t is not w for t, w in zip(of_stems, words, strict=True)])):
            yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "digest": pa.array(digests_of(terms), pa.int64()), "n": n}).filter(pa.array(kept, pa.bool_()))


def term_sets(codes):
    """What mapInArrow calls with (id, words), distinct words of a text: (id, hashes, weights, words), a set as functions/overlaps has them. codes: the broadcast Codes.

    An element is a stem's term with as many words as the text has of it, or a word without such a stem.
    """

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            coded = lists.flatten().dictionary_encode()
            words = coded.dictionary.to_pylist()
            terms = [term_of(w) for w in words]
            at = coded.indices.to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
            stemmed = np.array([t is not w for t, w in zip(terms, words, strict=True)], bool)[at]
            keys, n_words = np.unique((row << 32) + codes.value.of(terms)[at] - LEAST_CODE, return_counts=True)
            element = (keys & 0xFFFFFFFF) + LEAST_CODE
            bare = np.unique((row[~stemmed] << 32) + codes.value.of(words)[at[~stemmed]] - LEAST_CODE)
            weights = n_words + 1 - np.isin(keys, bare)
            word = codes.value.of(words)[at[stemmed]]
            offsets = lambda rows: pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(sizes)))]), pa.int32())
            lists_of = lambda values, rows: pa.ListArray.from_arrays(offsets(rows), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "hashes": lists_of(element, keys >> 32), "weights": lists_of(weights, keys >> 32), "words": lists_of(word, row[stemmed])})

    return run
