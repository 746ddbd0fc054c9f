"""Personal data under format-preserving Feistel pseudonyms, with DataFrame functions only.

Numbers and dates that pass their format's check are permuted within that format by a keyed Feistel network, so equal
values stay equal in all documents, different values stay different, and the result is valid again:

- payment cards: 13 to 19 digits with a right Luhn digit, unbroken, in fours, or grouped 4-6-5 or 4-6-4; the first digit
  stays, the Luhn digit is worked out anew;
- phone numbers of the North American form, without separators where area and exchange codes are 200 or more; these codes
  keep their class of first digit;
- social security numbers without the blocks that are never issued; IPv4 addresses;
- dates from 1900 to 2099 that exist, as year-month-day, day.month.year or month/day/year; where only day/month/year
  exists, the day is after the twelfth, and so is that of the pseudonym, which is read the same way (the 13th to 28th are
  permuted with all months, later days keep their number).

The network works on two numbers below ``a`` and ``b`` that together name a value of the format, a * b of them; in turn
each gets a keyed SHA-256 of the other added modulo its own range, so it is a permutation for any ranges. E-mail
addresses, access keys (AKIA, sk-, ghp_, AIzaSy) and values after password, token, secret or key have no such range; they
become keyed hashes of the same form and length, linked in the same way; an access key is one value with such a word
before it and without. Numbers that fail their check are no such data and stay.

The text is split at the matches and put together again around their pseudonyms: two passes of one pattern, the second
over texts with a match only, and no shuffle.

Defined cases: a null text stays null, an empty one empty; repeated rows are treated alike; further columns are carried
along by :func:`mask`; an empty table gives no rows; where matches could overlap the leftmost one counts; a text of any length
is masked whole, in time linear in its length, also where it is one unbroken run of any of the characters above.
"""

from __future__ import annotations

import os
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"  # possessive: matched in a loop, not by recursion
ACCESS_KEY = r"(?:AKIA[0-9A-Z]{16}|sk-[0-9A-Za-z]{20,}+|ghp_[0-9A-Za-z]{36}|AIzaSy[0-9A-Za-z_-]{33})(?![0-9A-Za-z])"
SECRET = r"""(?i:password|passwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}["']?[0-9A-Za-z_-]{8,}+"""
DATE = (
    r"(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3]?[0-9]\.[01]?[0-9]\.(?:19|20)[0-9]{2}|[0-3]?[0-9]/[0-3]?[0-9]/(?:19|20)[0-9]{2})(?![0-9])"
)
SSN = r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
IP = rf"(?<![0-9]\.)(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
_SEPARATED = r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
#: Where separators are missing, both codes start from 200 on, and decimals of a number are none.
_JOINED = r"(?<![0-9]\.)(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\)[ .-]?|[2-9][0-9]{2}[ .-]?)[2-9][0-9]{2}[ .-]?[0-9]{4}"
PHONE = rf"(?:{_SEPARATED}|{_JOINED})(?![0-9])"
CARD = r"(?:[0-9]{13,19}|[0-9]{4}([ -])(?:[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{6}\1[0-9]{4,5}))(?![0-9])"
ANY = rf"(?<![A-Za-z0-9._%+-]){EMAIL}|(?<![0-9A-Za-z_]){ACCESS_KEY}|(?<![A-Za-z]){SECRET}|(?<![0-9])(?=[0-9+(])(?:{DATE}|{SSN}|{IP}|{PHONE}|{CARD})"

#: Kinds in the order in which a match is told; the first whose pattern matches it whole is its kind.
KINDS = {"email": EMAIL, "access_key": ACCESS_KEY, "secret": SECRET, "date": DATE, "ssn": SSN, "ip": IP, "phone": PHONE, "card": CARD}


def default_key() -> str:
    return os.environ.get("LOOMSET_PII_KEY", "loomset")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _part(text: Column, start: int, length: int) -> Column:
    return F.substring(text, start, length).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str | Column) -> Column:
    """A keyed permutation of the pairs (left below a, right below b), as a struct (l, r)."""

    def drawn(x: Column, step: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), F.lit(kind) if isinstance(kind, str) else kind, a.cast("string"), b.cast("string"), step.cast("string"), x.cast("string"))
        return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 14), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        on_left = F.struct(F.pmod(s["l"] + drawn(s["r"], i), a).alias("l"), s["r"].alias("r"))
        on_right = F.struct(s["l"].alias("l"), F.pmod(s["r"] + drawn(s["l"], i), b).alias("r"))
        return F.when(i % 2 == 0, on_left).otherwise(on_right)

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), start, step)


def _pad(number: Column, width) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, one by one, by ``digits``."""

    def put(s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        taken = F.when(is_digit, F.substr(digits, s["k"], F.lit(1))).otherwise(c)
        return F.struct(F.concat(s["out"], taken).alias("out"), F.when(is_digit, s["k"] + 1).otherwise(s["k"]).alias("k"))

    return F.aggregate(F.split(form, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), put, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second one from the right doubled (nine less above nine)."""

    def add(s: Column, c: Column) -> Column:
        d = c.cast("int")
        double = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.struct((s["sum"] + F.when(s["twice"], double).otherwise(d)).alias("sum"), (~s["twice"]).alias("twice"))

    start = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("twice"))
    return F.aggregate(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), start, add, lambda s: s["sum"])


def card(text: Column, key: str) -> Column:
    def changed(d: Column) -> Column:
        n = F.char_length(d)
        inner = n - 2  # all but the first and the Luhn digit
        low = F.floor(inner / 2).cast("int")
        left, right = F.substr(d, F.lit(2), inner - low).cast("long"), F.substr(d, n - low, low).cast("long")
        a, b = F.pow(F.lit(10), inner - low).cast("long"), F.pow(F.lit(10), low).cast("long")

        def whole(p: Column) -> Column:
            body = F.concat(F.substring(d, 1, 1), _pad(p["l"], inner - low), _pad(p["r"], low))
            return _let(body, lambda x: F.concat(x, F.pmod(-luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")))

        return F.when(luhn_sum(d) % 10 == 0, _refill(text, _let(feistel(left, right, a, b, key, "card"), whole))).otherwise(text)

    return _let(_digits(text), changed)


def phone(text: Column, key: str) -> Column:
    def changed(d: Column) -> Column:
        ten = F.right(d, F.lit(10))
        area, exchange, line = _part(ten, 1, 3), _part(ten, 4, 3), _part(ten, 7, 4)
        area0 = F.when(area < 200, 0).otherwise(200)
        areas = F.when(area < 200, 200).otherwise(800)
        exchange0 = F.when((area < 200) | (exchange < 200), 0).otherwise(200)
        exchanges = F.when(area < 200, 1000).when(exchange < 200, 200).otherwise(800)
        left = (area - area0) * 100 + F.floor(line / 100)
        right = (exchange - exchange0) * 100 + line % 100

        def whole(p: Column) -> Column:
            last = (p["l"] % 100) * 100 + p["r"] % 100
            new = F.concat(_pad(F.floor(p["l"] / 100) + area0, 3), _pad(F.floor(p["r"] / 100) + exchange0, 3), _pad(last, 4))
            return F.concat(F.left(d, F.char_length(d) - 10), new)

        return _refill(text, _let(feistel(left, right, areas * 100, exchanges * 100, key, "phone"), whole))

    return _let(_digits(text), changed)


def ssn(text: Column, key: str) -> Column:
    area, group, serial = _part(text, 1, 3), _part(text, 5, 2), _part(text, 8, 4)
    left = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1

    def whole(p: Column) -> Column:
        index = F.floor(p["l"] / 99) + 1
        new_area = index + F.when(index >= 666, 1).otherwise(0)
        return F.concat(_pad(new_area, 3), F.lit("-"), _pad(p["l"] % 99 + 1, 2), F.lit("-"), _pad(p["r"] + 1, 4))

    return _let(feistel(left, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn"), whole)


def ip(text: Column, key: str) -> Column:
    def changed(o: Column) -> Column:
        octet = lambda i: o[i].cast("long")

        def whole(p: Column) -> Column:
            return F.concat_ws(".", *(x.cast("string") for half in ("l", "r") for x in (F.floor(p[half] / 256), p[half] % 256)))

        return _let(feistel(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536), key, "ip"), whole)

    return _let(F.split(text, r"\."), changed)


#: The 73,049 days from 1900 to 2099 as a product of two ranges.
_FIRST_DAY, _DAYS_A, _DAYS_B = "1900-01-01", 17, 4297


_MONTHS_31 = (1, 3, 5, 7, 8, 10, 12)


def _any_day(day: Column, key: str) -> Column:
    """A permutation of all days from 1900 to 2099."""
    days = F.datediff(day, F.lit(_FIRST_DAY).cast("date"))
    mixed = feistel(F.floor(days / _DAYS_B), days % _DAYS_B, F.lit(_DAYS_A), F.lit(_DAYS_B), key, "date")
    return _let(mixed, lambda p: F.date_add(F.lit(_FIRST_DAY).cast("date"), (p["l"] * _DAYS_B + p["r"]).cast("int")))


def _late_day(day: Column, key: str) -> Column:
    """A permutation of the days after the twelfth of a month: the 13th to 28th of all months among themselves, the 29th,
    30th and 31st among the months that have them, and 29 February among leap years."""
    year, month, number = F.year(day) - 1900, F.month(day), F.dayofmonth(day)
    early, last, leap = number <= 28, number == 31, (number == 29) & (month == 2)
    without_february = month - F.when(month > 2, 2).otherwise(1)
    place = F.array_position(F.array(*(F.lit(m) for m in _MONTHS_31)), month) - 1
    left = F.when(early, year * 12 + month - 1).when(leap, F.floor((year - 4) / 28)).otherwise(year)
    right = F.when(early, number - 13).when(leap, F.floor((year - 4) / 4) % 7).when(last, place).otherwise(without_february)
    a = F.when(early, 2400).when(leap, 7).otherwise(200)
    b = F.when(early, 16).when(leap, 7).when(last, 7).otherwise(11)

    def back(p: Column) -> Column:
        new_year = F.when(early, F.floor(p["l"] / 12)).when(leap, 4 + 28 * p["l"] + 4 * p["r"]).otherwise(p["l"]) + 1900
        other = p["r"] + F.when(p["r"] > 0, 2).otherwise(1)
        ends = F.element_at(F.array(*(F.lit(m) for m in _MONTHS_31)), (F.when(last, p["r"]).otherwise(0) + 1).cast("int"))
        new_month = F.when(early, p["l"] % 12 + 1).when(leap, 2).when(last, ends).otherwise(other)
        new_number = F.when(early, p["r"] + 13).otherwise(number)
        return F.make_date(new_year.cast("int"), new_month.cast("int"), new_number.cast("int"))

    kind = F.concat(F.lit("late date "), F.when(early, 28).otherwise(number).cast("string"))
    return _let(feistel(left, right, a, b, key, kind), back)


def date(text: Column, key: str) -> Column:
    forms = [  # (pattern, separator, places of year, month and day, permutation)
        (r"^[0-9]{4}-", "-", (0, 1, 2), _any_day),
        (r"\.", r"\.", (2, 1, 0), _any_day),
        (r"/", "/", (2, 0, 1), _any_day),
        (r"/", "/", (2, 1, 0), _late_day),  # read so only where the day is after the twelfth, and so is its pseudonym
    ]

    def in_form(day: Column, form: str, order: tuple[int, int, int], piece: Column) -> Column:
        values = {order[0]: F.year(day), order[1]: F.month(day), order[2]: F.dayofmonth(day)}
        widths = [F.lit(4) if i == order[0] else F.greatest(F.char_length(piece[i]), F.char_length(values[i].cast("string"))) for i in range(3)]
        return F.concat_ws(form.replace("\\", ""), *(_pad(values[i], widths[i]) for i in range(3)))

    def changed(form: str, order: tuple[int, int, int], permuted, piece: Column, found: Column) -> Column:
        return _let(permuted(found, key), lambda day: in_form(day, form, order, piece))

    out = None
    for pattern, form, order, permuted in forms:
        piece = F.split(text, form)
        iso = F.concat_ws("-", piece[order[0]], _pad(piece[order[1]], 2), _pad(piece[order[2]], 2))
        found = F.try_to_date(iso, "yyyy-MM-dd")
        test = text.rlike(pattern) & found.isNotNull()
        value = _let(found, partial(changed, form, order, permuted, piece))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(text)


def _hashed(text: Column, key: str, kind: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.lower(text)).cast("binary"), 256)


def email(text: Column, key: str) -> Column:
    return _let(_hashed(text, key, "email"), lambda h: F.concat(F.lit("u"), F.substring(h, 1, 12), F.lit("@"), F.substring(h, 13, 8), F.lit(".example")))


def access_key(text: Column, key: str) -> Column:
    def changed(head: Column) -> Column:
        n = F.char_length(text) - F.char_length(head)
        whole = F.sha2(F.concat_ws("|", F.lit(key), F.lit("access_key"), text).cast("binary"), 256)  # case counts
        return F.concat(head, F.substr(F.repeat(whole, F.ceil(n / 64).cast("int")), F.lit(1), n))

    upper = F.concat(F.lit("AKIA"), F.upper(F.substring(_hashed(text, key, "access_key"), 1, 16)))
    return F.when(text.startswith("AKIA"), upper).otherwise(_let(F.regexp_extract(text, "^(sk-|ghp_|AIzaSy)", 1), changed))


def secret(text: Column, key: str) -> Column:
    head = r"""(?s)^([A-Za-z_-]+?\s*[=:]\s*["']?)(.*)$"""

    def other(value: Column) -> Column:
        n = F.char_length(value)
        new = F.substr(F.repeat(_hashed(value, key, "secret"), F.ceil(n / 64).cast("int")), F.lit(1), n)
        return F.when(value == F.upper(value), F.upper(new)).otherwise(new)

    def changed(value: Column) -> Column:
        """A value that begins with an access key has that key's pseudonym, as it has on its own."""

        def split(found: Column) -> Column:
            rest = F.substr(value, F.char_length(found) + 1, F.char_length(value))
            return F.when(found != "", F.concat(access_key(found, key), _let(rest, other))).otherwise(other(value))

        return _let(F.regexp_extract(value, f"^{ACCESS_KEY}", 0), split)

    return F.concat(F.regexp_extract(text, head, 1), _let(F.regexp_extract(text, head, 2), changed))


_PSEUDONYM = {"email": email, "access_key": access_key, "secret": secret, "date": date, "ssn": ssn, "ip": ip, "phone": phone, "card": card}


def kind_of(match: Column) -> Column:
    out = None
    for kind, pattern in KINDS.items():
        test = match.rlike(f"^(?:{pattern})$")
        out = F.when(test, F.lit(kind)) if out is None else out.when(test, F.lit(kind))
    return out


def pseudonym(match: Column, kind: Column, key: str) -> Column:
    out = None
    for name, change in _PSEUDONYM.items():
        out = F.when(kind == name, change(match, key)) if out is None else out.when(kind == name, change(match, key))
    return out.otherwise(match)


def mask(docs: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in the text column; ``found`` names a column to add: an array of (kind, value, pseudonym)."""
    taken = {c.lower() for c in docs.columns}
    spare = next(n for i in range(len(taken) + 1) if (n := f"parts{i}") not in taken)
    changes = next(n for i in range(len(taken) + 1) if (n := f"changes{i}") not in taken)
    split = docs.withColumn(spare, F.split(F.col(text), ANY, -1))

    def change(m: Column) -> Column:
        return _let(kind_of(m), lambda k: F.struct(k.alias("kind"), m.alias("value"), pseudonym(m, k, key).alias("pseudonym")))

    matches = F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))
    empty = F.array().cast("array<struct<kind: string, value: string, pseudonym: string>>")
    changed = split.withColumn(changes, F.when(F.size(spare) > 1, F.transform(matches, change)).otherwise(empty))
    rest = F.slice(F.col(spare), F.lit(2), F.size(spare) - 1)
    joined = F.concat(F.col(spare)[0], F.array_join(F.zip_with(F.col(changes), rest, lambda c, p: F.concat(c["pseudonym"], p)), ""))
    new_text = F.when(F.size(spare) > 1, joined).otherwise(F.col(text))
    columns = [new_text.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    more = [F.filter(F.col(changes), lambda c: c["value"] != c["pseudonym"]).alias(found)] if found else []
    return changed.select(*columns, *more)


def counts(masked: DataFrame, found: str) -> DataFrame:
    """The column ``found`` of :func:`mask` as one count per kind, ``n_<kind>``."""
    def number(kind: str) -> Column:
        return F.size(F.filter(F.col(found), lambda c: c["kind"] == kind)).cast("long").alias(f"n_{kind}")

    each = [number(kind) for kind in KINDS]
    return masked.select(*(c for c in masked.columns if c != found), *each)
