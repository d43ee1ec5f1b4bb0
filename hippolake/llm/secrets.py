r"""Secret scans over a trigram inverted index, in DataFrame operations only.

Each rule is a regular expression. From its parse tree a Boolean trigram query is derived: an AND
over runs of literal text, each an OR over the strings the run may be, each an AND over that string's
trigrams. Postings (trigram, text) are built for the trigrams that some rule asks for; a rule's
candidates are the texts that its postings' intersections and unions leave, and only those are
verified with the rule's expression. A rule whose runs are all too short to ask for anything is
verified on every text. The index is over lower-cased text, so that a rule in either case can use it.
"""

from __future__ import annotations

import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hippolake.functions.arrays import once, scan as fold


def either_case(word: str) -> str:
    """word with each ASCII letter in either case; other characters, which case folding could add, don't match."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isascii() and c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if `group` of it has `at_least` characters. base: among the rules of the base digest."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 1
    base: bool = False


_NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + "|" + either_case("api") + "_?" + either_case("key")

#: The order is that of spans with the same start. Minimum lengths that a greedy run can carry itself are in its pattern.
RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", "AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", "[0-9a-f]{24,}", base=True),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[oprsu]_[A-Za-z0-9]{20,}"),
    Rule("slack", "xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,}"),
    # Behind a token's character no other token starts, and a run isn't given back: else each start in a run would be tried to its end.
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}"),
)

#: A run of literal text may be this many different strings at most; beyond, it ends.
MOST_STRINGS = 24


def _strings(op, value) -> set[str] | None:
    """The strings that a node may match, lower-cased, if they are few; else None."""
    name = str(op)
    if name == "LITERAL":
        return {chr(value).lower()}
    if name == "IN":
        found = set()
        for kind, what in value:
            if str(kind) == "LITERAL":
                found.add(chr(what).lower())
            elif str(kind) == "RANGE" and what[1] - what[0] < MOST_STRINGS:
                found |= {chr(c).lower() for c in range(what[0], what[1] + 1)}
            else:
                return None
        return found
    if name == "SUBPATTERN":
        return _sequence_strings(value[-1])
    if name == "BRANCH":
        parts = [_sequence_strings(p) for p in value[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if name == "MAX_REPEAT" and value[1] == 1:
        inner = _sequence_strings(value[2])
        return None if inner is None else inner | ({""} if value[0] == 0 else set())
    return None


def _sequence_strings(nodes) -> set[str] | None:
    found = {""}
    for op, value in nodes:
        here = _strings(op, value)
        if here is None or len(found) * len(here) > MOST_STRINGS:
            return None
        found = {a + b for a, b in product(found, here)}
    return found


#: A clause asks for this many of its string's trigrams, those with the fewest common letters. More would only narrow the candidates.
CLAUSE_GRAMS = 2
COMMON_LETTERS = " \"'etaoinshrdlu"


def _rarest(grams: set[str]) -> frozenset[str]:
    return frozenset(sorted(grams, key=lambda g: (sum(c in COMMON_LETTERS for c in g), g))[:CLAUSE_GRAMS])


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """AND over runs of OR over clauses of AND over trigrams; empty if the pattern asks for none."""
    runs: list[set[str]] = []
    current = {""}

    def end() -> None:
        nonlocal current
        runs.append(current)
        current = {""}

    for op, value in parser.parse(pattern):
        here = _strings(op, value)
        if here is None:
            end()
            if str(op) == "MAX_REPEAT" and value[0] >= 1 and (inner := _sequence_strings(value[2])):
                runs.append(inner)  # at least once
        elif len(current) * len(here) > MOST_STRINGS:
            end()
            current = here
        else:
            current = {a + b for a, b in product(current, here)}
    end()
    query = []
    for run in runs:
        clauses = {_rarest({s[i : i + 3] for i in range(len(s) - 2)}) for s in run}
        if all(clauses):  # a string under three characters asks for nothing, so neither does its run
            query.append(sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted))
    return query


def postings(texts: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, key) for each of `grams` in each text of (key, text); each pair once."""
    found = lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in grams]))
    held = F.flatten(F.transform(F.array(F.lower("text")), found))  # lowered once, not for each trigram
    return texts.select("key", F.explode(held).alias("gram")).distinct()


def candidates(index: DataFrame, queries: dict[str, list[list[frozenset[str]]]]) -> DataFrame:
    """(key, kinds): the rules whose trigram query the text with that key satisfies."""
    asked = [(kind, r, c, gram, len(clause)) for kind, query in queries.items() for r, run in enumerate(query) for c, clause in enumerate(run) for gram in sorted(clause)]
    clauses = index.sparkSession.createDataFrame(asked, "kind string, run int, clause int, gram string, need int")
    met = index.join(F.broadcast(clauses), "gram").groupBy("key", "kind", "run", "clause", "need").count().filter("count = need")  # the rules' own grams, a fixed few
    runs = F.create_map(*[x for kind, query in queries.items() for x in (F.lit(kind), F.lit(len(query)))])
    met = met.groupBy("key", "kind").agg(F.count_distinct("run").alias("met")).filter(F.col("met") == runs[F.col("kind")])
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


SPAN = "struct<start:bigint,place:int,end:bigint,kind:string>"


def rule_spans(text: Column, rule: Rule, place: int) -> Column:
    """array<struct<start, place, end, kind>> of the rule's matches, in code points.

    What stands between matches and the matches alternate, so that their lengths add up to positions.
    """
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, rule.pattern, -1)
    sized = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, hit: F.struct(F.length(gap).cast("long").alias("gap"), F.length(hit).cast("long").alias("length"), (F.length(F.regexp_extract(hit, rule.pattern, rule.group)) >= rule.at_least).alias("counts")))

    def step(at: Column, one: Column) -> tuple[Column, Column]:
        start = at + one["gap"]
        end = start + one["length"]
        return end, F.when(one["counts"], F.struct(start.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(rule.kind).alias("kind")))

    return F.when(F.rlike(text, pattern), fold(sized, F.lit(0).cast("long"), step, SPAN)).otherwise(F.array().cast(f"array<{SPAN}>"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, text, spans[, row].

    spans: array<struct<start, place, end, kind>>, by start, then the rules' order; per rule they are
    the leftmost matches that don't overlap, without those that are too short. Null texts are taken
    as empty. Copies of a text are indexed once, and found in each row. Other columns of docs are not
    read unless named in `keep`; those come back in the struct `row`. An empty table gives no rows.
    Texts of any length are scanned whole, in time in proportion to their length and their matches.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *row).withColumn("key", F.unhex(F.md5("text")))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    grams = sorted({g for q in queries.values() for run in q for clause in run for g in clause})
    if queries:
        index = postings(texts.select("key", "text"), grams)
        texts = texts.join(candidates(index, queries), "key", "left")
    else:
        texts = texts.withColumn("kinds", F.lit(None).cast("array<string>"))
    none = F.array().cast(f"array<{SPAN}>")
    found = [F.when(F.array_contains("kinds", r.kind), rule_spans(F.col("text"), r, i)).otherwise(none) if r.kind in queries else rule_spans(F.col("text"), r, i) for i, r in enumerate(rules)]
    return texts.withColumn("spans", F.array_sort(F.concat(*found))).drop("key", "kinds")


#: Characters of a text's pieces, from which parts are cut without going through all that stands before them.
PIECE = 2048


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """The characters start..end of the text whose pieces are given."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    piece = lambda i: F.get(pieces, i)
    inside = (start - first.cast("long") * PIECE).cast("int") + 1
    tail = F.substr(piece(last), F.lit(1), (end - last.cast("long") * PIECE).cast("int"))
    between = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    return F.when(end <= start, F.lit("")).when(first == last, F.substr(piece(first), inside, (end - start).cast("int"))).otherwise(F.concat(F.substr(piece(first), inside, F.lit(PIECE)), between, tail))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every span replaced by `mark`; spans that overlap are replaced as one. Linear in the text and its spans."""

    def made(pieces: Column) -> Column:
        def step(at: Column, s: Column) -> tuple[Column, Column]:
            return F.greatest(at, s["end"]), F.when(s["start"] >= at, F.concat(_cut(pieces, at, s["start"]), F.lit(mark)))

        last = F.aggregate(spans, F.lit(0).cast("long"), lambda at, s: F.greatest(at, s["end"]))
        return F.concat(F.array_join(fold(spans, F.lit(0).cast("long"), step, "string"), ""), _cut(pieces, last, F.length(text).cast("long")))

    return F.when(F.size(spans) == 0, text).otherwise(once(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)), made))


def digest(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, a count per base kind, the base spans' digest and all spans as text."""
    base = [r.kind for r in rules if r.base]
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return scanned.select("doc_id", *counts, F.sha2(written(of(*base)), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
