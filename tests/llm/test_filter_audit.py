"""The filter audit against a plain version that applies each order to each document."""

from __future__ import annotations

import re
from itertools import permutations

import pytest

from hippolake.llm import filter_audit

DOCS = "doc_id long, text string, source string, lang string, part string, words int, mask string, digest int, salt string"
LABELS = "doc_id long, quality int, toxic int, part string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", "x", 1, "m", 2, "n") for i, t, s in rows], DOCS)


def plain(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails = []
    for i, t, s in rows:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        flags = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text)), i is not None and i > first[text]]
        fails.append((s or "", i in good, i in toxic, {f for f, x in zip("ABCDE", flags, strict=True) if x}))
    out = {}
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[3]]
                failing = sum(f in d[3] for d in own)
                left = [d for d in left if f not in d[3]]
                out[part, "".join(order), step] = [len(left), len(removed), failing - len(removed), sum(d[3] == {f} for d in own), sum(d[1] for d in removed), sum(d[2] for d in removed)]
        totals = {f: sum(v[1] for (p, o, k), v in out.items() if p == part and o[k - 1] == f) for f in "ABCDE"}
        for (p, o, k), v in out.items():
            if p == part:
                v.append(totals[o[k - 1]])
    return out


CLEAN = " ".join(f"w{i}" for i in range(200))
ROWS = [
    (1, CLEAN, "a"), (2, CLEAN, "a"), (2, CLEAN, "b"), (2, CLEAN + " more", "b"), (None, CLEAN, "a"), (3, None, None), (4, "", ""), (5, " \t\n\x0b\x0c\r", "a"),
    (6, " ".join(["same"] * 300), "a"), (7, " ".join(["same"] * 100 + [f"u{i}" for i in range(99)]), "a"), (8, CLEAN + " A B C\x1cD # é", "b"), (9, "ABC $", "b"), (9, "ABC $", "b"),
    (10, CLEAN.upper(), "b"), (11, "x|" + CLEAN, "c"), (12, "é" * 98 + "AB", "c"), (13, "é" * 97 + "ABC", "c"), (14, "word " * 300_000, "c"), (None, None, None),
]
MARKS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, 1), (None, 1, 1), (8, 1, 0), (9, 1, 1), (99, 1, 1)]


def test_every_order_matches_a_plain_run(spark):
    labels = spark.createDataFrame([(*m, "x") for m in MARKS], LABELS)
    found = filter_audit.audit(docs_of(spark, ROWS), labels).collect()
    expected = plain(ROWS, MARKS)
    assert len(found) == len(expected) == 120 * 5 * 4
    for r in found:
        assert list(r[3:]) == expected[r.part, r.filter_order, r.step], r


def test_no_rows_and_no_labels(spark):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs_of(spark, []), labels).count() == 0
    found = {r.step: r for r in filter_audit.audit(docs_of(spark, [(1, None, None)]), labels).filter("filter_order = 'ABCDE'").collect()}
    assert found[1].removed == 1 and found[1].kept == 0 and found[2].redundant == 0 and found[1].shapley == 120


@pytest.mark.parametrize("rows", [3000])
def test_repeated_rows_of_one_id(spark, rows):
    docs = spark.range(rows).selectExpr("1L AS doc_id", f"'{CLEAN}' AS text", "'a' AS source")
    found = filter_audit.audit(docs, spark.createDataFrame([(1, 1, 0, "x")], LABELS)).filter("step = 5").collect()
    assert all((r.kept, r.removed) == (rows, 0) for r in found)
