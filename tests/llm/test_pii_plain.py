"""Pseudonyms against a plain version of detection, validation and permutation."""

from __future__ import annotations

import datetime
import hashlib
import re

import numpy as np

from hippolake.llm import pii

KEY = "plain"


def network(kind: str, a: int, b: int, a_size: int, b_size: int) -> tuple[int, int]:
    def f(i: int, half: int, size: int) -> int:
        return int(hashlib.sha256(f"{KEY}|{kind}|{i}|{half}".encode()).hexdigest()[:15], 16) % size

    for i in range(1, 9):
        if i % 2:
            a = (a + f(i, b, a_size)) % a_size
        else:
            b = (b + f(i, a, b_size)) % b_size
    return a, b


def digits_of(kind: str, digits: str) -> str:
    left = len(digits) // 2
    a, b = network(kind, int(digits[:left]), int(digits[left:]), 10**left, 10 ** (len(digits) - left))
    return f"{a:0{left}d}{b:0{len(digits) - left}d}"


def luhn(digits: str) -> int:
    return sum((d := int(c) * (2 - i % 2)) - 9 * (d > 9) for i, c in enumerate(digits))


def fill(shape: str, digits: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c in "0123456789" else c for c in shape)


def day_of(text: str) -> datetime.date | None:
    y, m, d = text.split("-") if text[4] == "-" else (text[6:], text[:2], text[3:5])
    try:
        day = datetime.date(int(y), int(m), int(d))
    except ValueError:
        return None
    return day if 1800 <= day.year <= 2199 else None


def plain(hit: str) -> tuple[str, str] | None:
    """Kind and pseudonym of a valid hit."""
    digits = re.sub("[^0-9]", "", hit)
    kind = next(k for k, p in pii.KINDS.items() if re.fullmatch(p, hit))
    if kind == "email":
        return kind, "u" + hashlib.sha256(f"{KEY}|email|{hit.lower()}".encode()).hexdigest()[:16] + "@example.invalid"
    if kind == "phone":
        return kind, fill(hit, digits[:-10] + digits_of("phone", digits[-10:]))
    if kind == "card":
        if luhn(digits) % 10:
            return None
        new = digits_of("card", digits[:15])
        return kind, fill(hit, new + str(-luhn(new + "0") % 10))
    if kind == "ip":
        p = [int(x) for x in hit.split(".")]
        if max(p) > 255:
            return None
        a, b = network("ip", p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536)
        return kind, f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if kind == "ssn":
        area, group, serial = (int(x) for x in hit.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        a, b = network("ssn", (area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999)
        place = a // 99
        return kind, f"{place + 1 + (place >= 665):03d}-{a % 99 + 1:02d}-{b + 1:04d}"
    day = day_of(hit)
    if not day:
        return None
    number = (day - datetime.date(1800, 1, 1)).days
    a, b = network("date", number // 773, number % 773, 189, 773)
    day = datetime.date(1800, 1, 1) + datetime.timedelta(a * 773 + b)
    return kind, day.strftime("%Y-%m-%d") if hit[4] == "-" else day.strftime("%m/%d/%Y")


def test_hits_and_permutations(spark):
    rng = np.random.default_rng(2)
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    card = lambda: (lambda d: d + str(-luhn(d + "0") % 10))(n(15))
    shapes = [
        lambda: f"a.b{n(2)}@mail{n(1)}.example.org", lambda: f"+1 ({n(3)}) {n(3)}-{n(4)}", lambda: f"({n(3)}) {n(3)}-{n(4)}", lambda: f"{n(3)}-{n(3)}-{n(4)}", lambda: f"+1-{n(3)}.{n(3)} {n(4)}",
        card, lambda: "-".join(re.findall("....", card())), lambda: n(16), lambda: ".".join(str(x) for x in rng.integers(0, 300, 4)), lambda: f"{n(3)}-{n(2)}-{n(4)}",
        lambda: f"{rng.integers(1790, 2210)}-{rng.integers(1, 14):02d}-{rng.integers(1, 32):02d}", lambda: f"{rng.integers(1, 14):02d}/{rng.integers(1, 32):02d}/{rng.integers(1790, 2210)}",
        lambda: n(9), lambda: "é日", lambda: "word",
    ]
    texts = ["".join(shapes[rng.integers(0, len(shapes))]() + (" ", ", ", "; ", "\n", "x")[rng.integers(0, 5)] for _ in range(30)) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, *texts[:5]])], "doc_id long, text string, hits int")
    rows = sorted(pii.pseudonymise(df, KEY).collect(), key=lambda r: r.doc_id)
    seen = set()
    for r, text in zip(rows, [*texts, *texts[:5]], strict=True):
        expected, out, at = [], "", 0
        for m in re.finditer(pii.ANY, text):
            if found := plain(m[0]):
                expected.append((found[0], m.start(), m.end(), found[1]))
                out += text[at : m.start()] + found[1]
                at = m.end()
        assert [tuple(h) for h in r.hits] == expected and r.text == out + text[at:]
        seen |= {k for k, *_ in expected}
    assert seen == set(pii.KINDS)


def test_a_very_long_text(spark):
    text = "x " * 500_000 + "10.1.2.3" + " y" * 500_000
    row = pii.pseudonymise(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string"), KEY).collect()
    assert len(row) == 2 and row[0] == row[1] and [(h.kind, h.start, h.end) for h in row[0].hits] == [("ip", 1_000_000, 1_000_008)]
