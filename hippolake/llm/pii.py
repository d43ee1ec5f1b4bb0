"""Personal data and its format-preserving pseudonyms, in DataFrame operations only.

One expression finds e-mail and IPv4 addresses, phone numbers, card and social security numbers and
dates; what it finds is validated (card check digits, octets, calendar, ...). Numbers and dates are
then permuted within their format by a keyed Feistel network over the pairs (a, b) of two residues,
so a pseudonym is as valid as what it stands for, different values stay different and equal ones
equal, in all documents. Names in e-mail addresses are letters of any length, for which no such
domain is small enough; they become keyed digests at a reserved domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hippolake.functions.arrays import once as _once
from hippolake.functions.arrays import scan

ROUNDS = 8

EMAIL = r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
PHONE = r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}|\+1[-. ][0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}|\([0-9]{3}\) [0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}"
CARD = r"[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}"
IP = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}"

#: Kinds in order of precedence, and the expression of any of them between characters that can't continue it.
KINDS = {"email": EMAIL, "phone": PHONE, "card": CARD, "ip": IP, "ssn": SSN, "date": DATE}
# The first character is looked at before what may not stand before it: most positions end there.
ANY = (
    r"(?:(?=[0-9A-Za-z._%+-])(?<![0-9A-Za-z._%+@-])" + EMAIL + r"(?![0-9A-Za-z@-])"
    r"|(?=[0-9(+])(?<![0-9A-Za-z+-])(?:" + PHONE + "|" + CARD + "|" + r"(?<![0-9]\.)" + IP + r"(?!\.[0-9])|" + SSN + "|" + DATE + r")(?![0-9A-Za-z-]))"
)
#: Days of the calendar's period, and factors of their number: a date is a pair of residues.
FIRST_DAY, DAYS, DAY_FACTORS = "1800-01-01", 146_097, (189, 773)


def feistel(key: str, kind: str, a: Column, b: Column, a_size: int, b_size: int) -> Column:
    """A keyed permutation of the pairs (a, b), 0 <= a < a_size, 0 <= b < b_size: struct<a, b>."""

    def f(i: Column, half: Column, size: int) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size

    def step(acc: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, F.pmod(acc["a"] + f(i, acc["b"], a_size), F.lit(a_size))).otherwise(acc["a"]).alias("a"),
            F.when(odd, acc["b"]).otherwise(F.pmod(acc["b"] + f(i, acc["a"], b_size), F.lit(b_size))).alias("b"),
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def permute_digits(key: str, kind: str, digits: Column, n: int) -> Column:
    """A permutation of the strings of n digits."""
    left, right = n // 2, n - n // 2
    mixed = feistel(key, kind, F.substring(digits, 1, left), F.substring(digits, left + 1, right), 10**left, 10**right)
    return _once(mixed, lambda m: F.concat(F.lpad(m["a"].cast("string"), left, "0"), F.lpad(m["b"].cast("string"), right, "0")))


def _fill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced in turn by `digits`."""
    folded = F.aggregate(
        F.split(shape, ""),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("used")),
        lambda acc, c: F.when(
            c.rlike("[0-9]"), F.struct(F.concat(acc["out"], F.substr(digits, acc["used"] + 1, F.lit(1))).alias("out"), (acc["used"] + 1).alias("used"))
        ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["used"].alias("used"))),
    )
    return folded["out"]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """The sum that a valid card's 16 digits bring to a multiple of ten."""
    each = F.transform(F.split(digits, ""), lambda d, i: F.when(i % 2 == 0, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(F.slice(each, 1, 16), F.lit(0), lambda acc, d: acc + d)


def _day(text: Column) -> Column:
    """The date, if it is one within the period; else null."""
    iso = F.when(F.substring(text, 5, 1) == "-", text).otherwise(F.concat_ws("-", F.substring(text, 7, 4), F.substring(text, 1, 2), F.substring(text, 4, 2)))
    day = F.try_to_date(iso, "yyyy-MM-dd")
    return F.when(F.year(day).between(1800, 2199), day)


def _ip_parts(text: Column) -> Column:
    return F.transform(F.split(text, r"\."), lambda p: p.cast("int"))


def classify(hit: Column) -> Column:
    """The kind of something that ANY matched, null if it isn't valid. Dates written with slashes are month/day/year."""
    whole = lambda kind: hit.rlike(f"^(?:{KINDS[kind]})$")
    return (
        F.when(whole("email"), "email")
        .when(whole("phone"), "phone")
        .when(whole("card"), F.when(_luhn_sum(_digits(hit)) % 10 == 0, "card"))
        .when(whole("ip"), F.when(F.forall(_ip_parts(hit), lambda p: p <= 255), "ip"))
        .when(whole("ssn"), F.when(~hit.rlike("^(?:000|666|9)|-00-|-0000$"), "ssn"))
        .when(whole("date"), F.when(_day(hit).isNotNull(), "date"))
    )


def pseudonym(key: str, kind: Column, hit: Column) -> Column:
    """What stands for a valid hit; the hit itself where kind is null."""
    digits = _digits(hit)
    national = F.substring(digits, -10, 10)  # the country code stays
    phone = _fill(hit, F.concat(F.substr(digits, F.lit(1), F.length(digits) - 10), permute_digits(key, "phone", national, 10)))
    # Fifteen digits are permuted, the sixteenth checks them.
    payload = permute_digits(key, "card", F.substring(digits, 1, 15), 15)
    card = _once(payload, lambda p: F.concat(p, F.pmod(10 - _luhn_sum(F.concat(p, F.lit("0"))) % 10, F.lit(10)).cast("string")))
    parts = _ip_parts(hit)
    mixed = feistel(key, "ip", F.get(parts, 0) * 256 + F.get(parts, 1), F.get(parts, 2) * 256 + F.get(parts, 3), 65536, 65536)
    ip = _once(mixed, lambda m: F.concat_ws(".", *[F.floor(m[h] / 256).cast("string") if top else (m[h] % 256).cast("string") for h in ("a", "b") for top in (True, False)]))
    # Area, group and serial of a valid number: 898 areas below 900 without 000 and 666, 99 groups, 9999 serials.
    area = F.substring(digits, 1, 3).cast("int")
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    ssn_mixed = feistel(key, "ssn", place * 99 + F.substring(digits, 4, 2).cast("int") - 1, F.substring(digits, 6, 4).cast("int") - 1, 898 * 99, 9999)
    def ssn_text(m: Column) -> Column:
        p = F.floor(m["a"] / 99)
        return F.concat_ws("-", F.lpad(F.when(p >= 665, p + 2).otherwise(p + 1).cast("string"), 3, "0"), F.lpad((m["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((m["b"] + 1).cast("string"), 4, "0"))
    ssn = _once(ssn_mixed, ssn_text)
    number = F.datediff(_day(hit), F.lit(FIRST_DAY).cast("date"))
    date_mixed = feistel(key, "date", F.floor(number / DAY_FACTORS[1]), number % DAY_FACTORS[1], *DAY_FACTORS)
    def date_text(m: Column) -> Column:
        day = F.date_add(F.lit(FIRST_DAY).cast("date"), (m["a"] * DAY_FACTORS[1] + m["b"]).cast("int"))
        return F.when(F.substring(hit, 5, 1) == "-", F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "MM/dd/yyyy"))
    date = _once(date_mixed, date_text)
    email = F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(hit)), 256), 1, 16), F.lit("@example.invalid"))
    return F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", _fill(hit, card)).when(kind == "ip", ip).when(kind == "ssn", ssn).when(kind == "date", date).otherwise(hit)


HIT = "struct<kind:string,start:bigint,end:bigint,pseudonym:string>"


def pseudonymise(docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text with pseudonyms, hits.

    hits: array<struct<kind, start, end, pseudonym>> by position in the original text, in code points,
    end exclusive. Numbers that fail their check, such as card numbers with a wrong check digit, are
    left as they are. Null texts stay null, with no hits; texts without personal data come back
    unchanged. Other columns of docs are not read; an empty table gives no rows. Repeated rows come back
    as often as they occur, with equal pseudonyms. Texts of any length are read whole, in time in
    proportion to their length and their hits.
    """
    text = F.col("text")
    raw = F.when(text.rlike(ANY), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("raw", raw)
    judged = F.transform("raw", lambda h: F.struct(h.alias("hit"), classify(h).alias("kind")))
    renamed = F.transform("judged", lambda j: F.struct(j["hit"].alias("hit"), j["kind"].alias("kind"), pseudonym(key, j["kind"], j["hit"]).alias("pseudonym")))
    some = F.size("raw") > 0
    found = found.withColumn("judged", F.when(some, judged)).withColumn("named", F.when(some, renamed)).withColumn("between", F.when(some, F.split("text", ANY, -1)))
    joined = F.concat(F.array_join(F.zip_with(F.slice("between", F.lit(1), F.size("named")), "named", lambda gap, n: F.concat(gap, n["pseudonym"])), ""), F.element_at("between", -1))
    none = F.array().cast(f"array<{HIT}>")
    sized = F.zip_with(F.slice("between", F.lit(1), F.size("named")), "named", lambda gap, n: F.struct(F.length(gap).cast("long").alias("gap"), F.length(n["hit"]).cast("long").alias("length"), n["kind"].alias("kind"), n["pseudonym"].alias("pseudonym")))

    def step(at: Column, one: Column) -> tuple[Column, Column]:
        start = at + one["gap"]
        end = start + one["length"]
        return end, F.when(one["kind"].isNotNull(), F.struct(one["kind"].alias("kind"), start.alias("start"), end.alias("end"), one["pseudonym"].alias("pseudonym")))

    hits = scan(sized, F.lit(0).cast("long"), step, HIT)
    return found.select("doc_id", F.when(some, joined).otherwise(text).alias("text"), F.when(some, hits).otherwise(none).alias("hits"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, text, a count per kind, and the spans as text."""
    of = lambda kind: F.size(F.filter("hits", lambda h: h["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(kind) for kind in KINDS]
    spans = F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["kind"], h["start"].cast("string"), h["end"].cast("string"))), ",")
    return found.select("doc_id", "text", *counts, spans.alias("spans"))
