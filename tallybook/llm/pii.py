"""Pseudonyms for personal data, in DataFrame operations only.

Numbers and dates that pass their checks are permuted within their own format by a
keyed Feistel network, so a value always becomes the same other value of its kind,
in every document, and different values stay different.  A network works on a pair
(x, y) of a domain a by b: in turn x moves by a keyed hash of y, modulo a, and y by one
of x, modulo b.  Whoever has the key can turn it back (``restore``).

| kind | checked | permuted |
|---|---|---|
| card | 13 to 19 digits, Luhn | all digits but the last, which is computed anew |
| phone | ten digits after an optional +country code | the ten digits |
| ssn | ranges of the three parts | the number's place among all valid ones |
| ip | four numbers up to 255 | all 32 bits |
| date | a day from 1700 to 2099 | the day's place in these 400 years |
| email | form only | replaced by a keyed hash of 64 bits, not reversible |

Separators stay where they are and do not count: a number written in another way
gets the same digits.  What fails its check stays as it is.

Defined results: a null text stays null and an empty one empty, with no finds.  Where
two kinds could match, the one that begins first counts, then the order of ``KINDS``.
Repeated rows are answered one by one.  Other columns keep their values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DAYS = 146_097  # of 400 years
DAY_PARTS = (189, 773)
FIRST_DAY = "1700-01-01"
AREAS, GROUPS, SERIALS = 898, 99, 9999

# The forms of each kind.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![0-9.])\d{1,3}(?:\.\d{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![0-9/-]|\.[0-9])",
    "ssn": r"(?<![0-9-])\d{3}-\d{2}-\d{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![0-9])|(?<![0-9+])\+\d{1,3}[ .-]?\d{10}(?![0-9])",
    "card": r"(?<![0-9])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![0-9])",
}
ANY = "|".join(KINDS.values())
DATE_FORMATS = ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy")


def _hash(key: str, kind: str, step: Column, value: Column) -> Column:
    """60 bits of a keyed hash."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _permuted(x: Column, y: Column, a: Column, b: Column, key: str, kind: str, back: bool) -> Column:
    """struct(x, y) after all rounds, or with all rounds undone."""

    def round_(s: Column, i: Column) -> Column:
        sign = -1 if back else 1
        even = i % 2 == 0
        x = F.when(even, F.pmod(s["x"] + sign * (_hash(key, kind, i, s["y"]) % a), a)).otherwise(s["x"])
        y = F.when(even, s["y"]).otherwise(F.pmod(s["y"] + sign * (_hash(key, kind, i, s["x"]) % b), b))
        return F.struct(x.alias("x"), y.alias("y"))

    order = range(ROUNDS)[::-1] if back else range(ROUNDS)
    steps = F.array(*map(F.lit, order))
    return F.aggregate(steps, F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), round_)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _power(n: Column) -> Column:
    return F.element_at(F.array(*(F.lit(10**i) for i in range(11))), n.cast("int") + 1)


def _pad(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), n if isinstance(n, Column) else F.lit(n), F.lit("0"))


def _written_as(m: Column, digits: Column) -> Column:
    """``digits`` in the places of the digits of ``m``."""
    def at(i: Column) -> Column:
        c = m.substr(i, F.lit(1))
        return F.when(c.rlike("[0-9]"), digits.substr(F.length(_digits(m.substr(F.lit(1), i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), at), "")


def _rewritten(m: Column, digits: Column) -> Column:
    return _let(digits, lambda d: _written_as(m, d))


def _halves(digits: Column, n: Column, key: str, kind: str, back: bool) -> Column:
    """The number permuted among all of ``n`` digits."""
    k = F.floor(n / 2).cast("int")
    rest = (n - k).cast("int")
    x = digits.substr(F.lit(1), k).cast("long")
    y = digits.substr(k + 1, rest).cast("long")
    new = _permuted(x, y, _power(k), _power(rest), key, kind, back)
    return _let(new, lambda p: F.concat(_pad(p["x"], k), _pad(p["y"], rest)))


def _check_digit(body: Column) -> Column:
    """The digit that the Luhn rule puts behind ``body``."""

    def weigh(total: Column, i: Column) -> Column:  # i counts from the right
        d = body.substr(F.length(body) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(body) - 1), F.lit(0), weigh)
    return F.pmod(-total, F.lit(10)).cast("string")


def _card(m: Column, key: str, back: bool) -> Column:
    digits = _digits(m)
    size = F.length(digits) - 1
    valid = _check_digit(digits.substr(F.lit(1), size)) == digits.substr(size + 1, F.lit(1))
    whole = _let(_halves(digits, size, key, "card", back), lambda body: F.concat(body, _check_digit(body)))
    return F.when(valid, _rewritten(m, whole)).otherwise(m)


def _phone(m: Column, key: str, back: bool) -> Column:
    digits = _digits(m)
    country = F.length(digits) - 10
    new = _halves(digits.substr(country + 1, F.lit(10)), F.lit(10), key, "phone", back)
    return _rewritten(m, F.concat(digits.substr(F.lit(1), country), new))


def _ssn(m: Column, key: str, back: bool) -> Column:
    area, group, serial = (m.substr(a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    new = _permuted(place * GROUPS + group - 1, serial - 1, F.lit(AREAS * GROUPS), F.lit(SERIALS), key, "ssn", back)

    def write(p: Column) -> Column:
        new_area = F.floor(p["x"] / GROUPS) + 1
        new_area = new_area + F.when(new_area > 665, 1).otherwise(0)
        return F.concat_ws("-", _pad(new_area, 3), _pad(p["x"] % GROUPS + 1, 2), _pad(p["y"] + 1, 4))

    return F.when(valid, _let(new, write)).otherwise(m)


def _ip(m: Column, key: str, back: bool) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    valid = ~F.exists(parts, lambda x: x > 255)
    x, y = parts[0] * 256 + parts[1], parts[2] * 256 + parts[3]
    new = _permuted(x, y, F.lit(65536), F.lit(65536), key, "ip", back)

    def write(p: Column) -> Column:
        return F.concat_ws(".", *(f.cast("string") for v in (p["x"], p["y"]) for f in (F.floor(v / 256), v % 256)))

    return F.when(valid, _let(new, write)).otherwise(m)


def _date(m: Column, key: str, back: bool) -> Column:
    out = F.lit(None).cast("string")
    for form in DATE_FORMATS:
        day = F.try_to_timestamp(m, F.lit(form)).cast("date")
        n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        a, b = DAY_PARTS
        place = _let(_permuted(F.floor(n / b), n % b, F.lit(a), F.lit(b), key, "date", back), lambda p: p["x"] * b + p["y"])  # noqa: B023
        new = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), place.cast("int")), form)
        fits = F.length(m) == len(form)
        fits &= m.substr(5 if form[0] == "y" else 3, 1) == form[4 if form[0] == "y" else 2]
        out = F.coalesce(out, F.when(fits & n.between(0, DAYS - 1), new))
    return F.coalesce(out, m)


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 16), F.lit("@pseudonym.invalid"))


def _kind_of(m: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, form in reversed(KINDS.items()):
        out = F.when(m.rlike(rf"^(?:{form})$"), kind).otherwise(out)
    return out


def _pseudonym(m: Column, kind: Column, key: str, back: bool) -> Column:
    numbers = {"ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}
    out = m
    for name, change in numbers.items():
        out = F.when(kind == name, change(m, key, back)).otherwise(out)
    return out if back else F.when(kind == "email", _email(m, key)).otherwise(out)


def pseudonyms(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """doc_id, text with its personal data exchanged, and the finds (kind, value, pseudonym) of every row."""
    if not key:
        raise ValueError("pseudonyms need a key")
    text = F.col("text")
    none = F.array().cast("array<string>")
    # most texts hold neither a digit nor an @ and need no further pass
    some = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    rows = docs.select("doc_id", "text", F.when(some, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none).alias("values"))

    def find(m: Column) -> Column:
        return F.struct(_kind_of(m).alias("kind"), m.alias("value"))

    def change(f: Column) -> Column:
        return F.struct(f["kind"].alias("kind"), f["value"].alias("value"), _pseudonym(f["value"], f["kind"], key, back).alias("pseudonym"))

    rows = rows.select("doc_id", "text", F.transform(F.transform("values", find), change).alias("finds"))
    between = F.split(text, ANY, -1)
    pieces = F.zip_with(between, F.col("finds.pseudonym"), lambda gap, new: F.concat(gap, F.coalesce(new, F.lit(""))))
    changed = F.when(F.size("finds") > 0, F.array_join(pieces, "")).otherwise(text)
    found = F.filter("finds", lambda f: f["value"] != f["pseudonym"])
    return rows.select("doc_id", changed.alias("text"), found.alias("finds"))


def restore(docs: DataFrame, key: str) -> DataFrame:
    """:func:`pseudonyms` undone, but for e-mail addresses."""
    return pseudonyms(docs, key, back=True)


def report(found: DataFrame) -> DataFrame:
    """doc_id, how many values of each kind were exchanged, and the new text."""

    def of(kind: str):
        return lambda f: f["kind"] == kind

    counts = [F.size(F.filter("finds", of(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, "text")
