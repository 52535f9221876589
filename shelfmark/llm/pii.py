"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Values are found by pattern, validated (check digits, ranges, calendar) and permuted within their
format by a keyed Feistel network, so equal values get equal pseudonyms in every document and every
notation, different values different ones, and a validated value stays valid. What does not validate
is left as it is.

* Card numbers (13 to 19 digits, Luhn-valid; whole or in groups of 4-4-4-n or 4-6-n): all digits but the
  last are permuted, the last is computed anew. IBANs, whole or in groups of four: the account part is
  permuted, the check digits are computed anew.
* Phone numbers: the national digits are permuted, whatever stands between them; the country code, read
  off the digits, stays, and so does a trunk zero in brackets. Social security numbers (ranges checked),
  e-mail addresses (the part before ``@``; letters and digits of each class stay in their class), IPv4
  addresses (octets up to 255) and secrets after ``token``, ``secret``, ``password`` or ``api_key``
  (hexadecimal letters stay such).
* Dates (ISO, or day and month with / or ., in either order, with or without leading zeros; valid in the
  calendar): permuted over 400 years among the dates that print alike: the day stays within 1 to 9, 10 to
  12 or 13 to 31 and the month within 1 to 9 or 10 to 12, so each notation keeps its digits and no
  month-first date turns into a day-first one. The 29th of February stays one, in another leap year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

ROUNDS = 8
#: Dates are permuted over this many years from this one on.
YEARS, YEAR = 400, 1800
#: By kind of date: first day, first month, days of each month (without leap days), and two factors of
#: the number of such dates in ``YEARS``.
DATES = (
    (1, 1, (9,) * 9, 180, 180),
    (1, 10, (9,) * 3, 100, 108),
    (10, 1, (3,) * 9, 100, 108),
    (10, 10, (3,) * 3, 60, 60),
    (13, 1, (19, 16, 19, 18, 19, 18, 19, 19, 18), 250, 264),
    (13, 10, (19, 18, 19), 140, 160),
)
#: Leap years of the period.
LEAPS = [y for y in range(YEAR, YEAR + YEARS) if y % 4 == 0 and (y % 100 or y % 400 == 0)]

# The lengths of IBANs by country, and the country codes of one and two digits.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
CODES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"


def _grouped(length: int, countries: str) -> str:
    whole, rest = divmod(length - 4, 4)
    one = lambda sep: rf"\d{{2}}(?:{sep}[A-Z0-9]{{4}}){{{whole}}}" + (rf"{sep}[A-Z0-9]{{{rest}}}" if rest else "")
    return f"(?:{countries.replace(' ', '|')})(?:{one(' ')}|{one('-')})"


# The patterns, by kind, in order of precedence.
PATTERNS = (
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}(?![A-Za-z0-9-])|(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"),
    ("secret", r"(?i:\b(?:api[_-]?key|access[_-]?key|auth[_-]?token|token|secret|passwd|password)\b\s*[=:]\s*[\"']?)[A-Za-z0-9_\-+/]{16,}+"),
    ("iban", r"(?<![A-Za-z0-9])(?:[A-Z]{2}\d{2}[A-Z0-9]{11,30}|" + "|".join(_grouped(n, c) for n, c in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])"),
    ("phone", r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?(?:\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\d(?:[ .-]?\d{2,4}){2,3})(?![\d])|(?<![\d-])(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}(?![\d-])"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("ip", r"(?<!\d)(?<!\d\.)(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"),
    ("date", r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-]|\.\d)"),
    ("card", r"(?<!\d)(?<!\d[.,-])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7}|\d{4} \d{6} \d{4,5}|\d{4}-\d{6}-\d{4,5})(?!\d|[.,-]\d)"),
)
PATTERN = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: Every match holds one of these.
NEEDED = "[0-9@=]"
#: First code point and number of the letters of a class; a character stays in its class.
CLASSES = ((48, 10), (97, 26), (65, 26), (224, 23), (192, 23), (248, 8), (216, 7))
#: In secrets, letters of hexadecimal numbers are classes of their own.
SECRET_CLASSES = ((48, 10), (97, 6), (103, 20), (65, 6), (71, 20))


def _s(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _bytes_at(hexes: Column, i: Column) -> Column:
    return F.conv(F.substring(hexes, (2 * (i % 64) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _shift(c: Column, n: Column, classes: tuple) -> Column:
    """Moves a character on by ``n`` within its class; others stay."""
    code = F.ascii(c)
    out = None
    for lo, many in classes:
        inside, moved = code.between(lo, lo + many - 1), F.char(lo + (code - lo + n) % many)
        out = F.when(inside, moved) if out is None else out.when(inside, moved)
    return out.otherwise(c)


def permute_text(value: Column, key: str, kind: str, rounds: int = ROUNDS, classes: tuple = CLASSES) -> Column:
    """Feistel network over the characters of a string: halves take turns, each moved within the
    classes of its characters by bytes of a keyed SHA-512 of the other half."""
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("a"), F.substring(value, half + 1, F.length(value)).alias("b"))

    def turn(s: Column, k: Column) -> Column:
        h = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), k.cast("string"), F.length(s["a"]).cast("string"), s["b"]), 512)
        moved = F.array_join(F.transform(_chars(s["a"]), lambda c, i: _shift(c, _bytes_at(h, i), classes)), "")
        return F.struct(s["b"].alias("a"), moved.alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn, lambda s: F.concat(s["a"], s["b"]))


def _permute_pair(a: Column, b: Column, ma: int | Column, mb: int | Column, key: str, kind: str | Column, rounds: int = ROUNDS) -> Column:
    """Feistel network over two numbers below ``ma`` and ``mb``: returns struct(a, b)."""

    def turn(s: Column, k: Column) -> Column:
        def f(x: Column, tag: str, mod: int | Column) -> Column:
            h = F.sha2(F.concat_ws("|", F.lit(key), _s(kind), F.lit(tag), k.cast("string"), x.cast("string")), 256)
            return F.conv(F.substring(h, 1, 12), 16, 10).cast("long") % mod

        new_a = (s["a"] + f(s["b"], "a", ma)) % ma
        # The second half uses the first as it is now, so a turn is two rounds.
        return F.struct(new_a.alias("a"), ((s["b"] + f(new_a, "b", mb)) % mb).alias("b"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds // 2)), start, turn)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn check over a string of digits, the last one counting once."""
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return s + twice

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _refill(shape: Column, chars: Column, slot: str = "[0-9]") -> Column:
    """Puts characters, in order, where ``shape`` has one that matches ``slot``."""

    def put(s: Column, c: Column) -> Column:
        fits = c.rlike(slot)
        at = s["at"] + F.when(fits, 1).otherwise(0)
        return F.struct(at.alias("at"), F.concat(s["out"], F.when(fits, F.substring(chars, at, F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(_chars(shape), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put, lambda s: s["out"])


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    body = permute_text(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
    check = F.transform(F.array(body), lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))[0]
    return F.when((F.length(d).between(13, 19)) & (luhn_sum(d) % 10 == 0), _refill(m, check)).otherwise(m)


def _mod97(text: Column) -> Column:
    """Remainder by 97 of an IBAN's rearranged characters, letters counting from 10."""

    def add(r: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(v > 9, (r * 100 + v) % 97).otherwise((r * 10 + v) % 97).cast("int")

    return F.aggregate(_chars(F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))), F.lit(0), add)


def _iban(m: Column, key: str) -> Column:
    plain = F.regexp_replace(m, "[ -]", "")
    country = F.substring(plain, 1, 2)
    body = permute_text(F.substring(plain, F.lit(5), F.length(plain)), key, "iban")

    def whole(b: Column) -> Column:
        zero = F.concat(country, F.lit("00"), b)
        return F.concat(country, F.lpad((98 - _mod97(zero)).cast("string"), 2, "0"), b)

    # Check digits go from 02 to 98; 00, 01 and 99 would leave the same remainder.
    ok = (_mod97(plain) == 1) & F.substring(plain, 3, 2).cast("int").between(2, 98)
    return F.when(ok, _refill(m, F.transform(F.array(body), whole)[0], "[A-Z0-9]")).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    # The country code, and a trunk zero in brackets that callers from abroad leave out.
    head = F.regexp_extract(m, rf"^\+(?:{CODES}|\d{{3}})[ .-]?(?:\(0\))?", 0)
    rest = F.substring(m, F.length(head) + 1, F.length(m))
    return F.concat(head, _refill(rest, permute_text(_digits(rest), key, "phone")))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, b).cast("int") for a, b in ((1, 3), (5, 2), (8, 4)))
    ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    # 898 areas (666 is none), 99 groups and 9,999 serial numbers, as one pair of numbers.
    place = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1
    q = _permute_pair(place, serial - 1, 898 * 99, 9999, key, "ssn")

    def show(x: Column) -> Column:
        at = F.floor(x["a"] / 99) + 1
        at = F.when(at >= 666, at + 1).otherwise(at)
        return F.concat_ws("-", F.lpad(at.cast("string"), 3, "0"), F.lpad((x["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((x["b"] + 1).cast("string"), 4, "0"))

    return F.when(ok, F.transform(F.array(q), show)[0]).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    ok = (F.size(o) == 4) & F.forall(o, lambda x: x <= 255)
    q = _permute_pair(F.element_at(o, 1) * 256 + F.element_at(o, 2), F.element_at(o, 3) * 256 + F.element_at(o, 4), 65536, 65536, key, "ip")

    def show(x: Column) -> Column:
        return F.concat_ws(".", *[F.floor(x[h] / 256 if hi else x[h] % 256).cast("string") for h in "ab" for hi in (True, False)])

    return F.when(ok, F.transform(F.array(q), show)[0]).otherwise(m)


def _date(m: Column, key: str) -> Column:
    iso = m.contains("-")
    text = F.split(m, "[-/.]")
    parts = F.transform(text, lambda x: x.cast("int"))
    one, two, three = (F.element_at(parts, i) for i in (1, 2, 3))
    swapped = ~iso & (two > 12)  # month before day
    y = F.when(iso, one).otherwise(three)
    mo = F.when(iso, two).otherwise(F.when(swapped, one).otherwise(two))
    d = F.when(iso, three).otherwise(F.when(swapped, two).otherwise(one))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.get(F.array(F.lit(31), F.when(leap, 29).otherwise(28), *[F.lit(n) for n in (31, 30, 31, 30, 31, 31, 30, 31, 30, 31)]), mo - 1)
    ok = y.between(YEAR, YEAR + YEARS - 1) & d.between(1, last)
    kind = F.when(d < 10, 0).when(d < 13, 2).otherwise(4) + F.when(mo < 10, 0).otherwise(1)
    found = F.struct(kind.alias("kind"), (y - YEAR).alias("y"), mo.alias("mo"), d.alias("d"))

    def moved(x: Column) -> Column:
        """Year, month and day of another date of the same kind."""

        def of(values: list) -> Column:
            return F.element_at(F.array(*[F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for v in values]), x["kind"] + 1)

        sums = of([[sum(days[:i]) for i in range(len(days))] for _, _, days, _, _ in DATES])
        year = of([sum(days) for _, _, days, _, _ in DATES])
        day, month = of([a for a, *_ in DATES]), of([b for _, b, *_ in DATES])
        ma, mb = of([a for *_, a, _ in DATES]), of([b for *_, b in DATES])
        n = x["y"] * year + F.get(sums, x["mo"] - month) + x["d"] - day
        q = _permute_pair(F.floor(n / mb), n % mb, ma, mb, key, F.concat(F.lit("date"), x["kind"].cast("string")))
        # Bound one after another, so that the network is computed once.
        at = F.transform(F.array(q), lambda p: p["a"] * mb + p["b"])
        at = F.transform(at, lambda k: F.struct(F.floor(k / year).alias("y"), (k % year).alias("k")))
        at = F.transform(at, lambda p: F.struct(p["y"].alias("y"), p["k"].alias("k"), F.size(F.filter(sums, lambda s: s <= p["k"])).alias("nth")))
        return F.transform(at, lambda p: F.struct((p["y"] + YEAR).cast("int").alias("y"), (p["nth"] + month - 1).cast("int").alias("mo"), (p["k"] - F.get(sums, p["nth"] - 1) + day).cast("int").alias("d")))[0]

    def leap_day(x: Column) -> Column:
        h = F.sha2(F.concat_ws("|", F.lit(key), F.lit("leap")), 256)
        step, start = (F.conv(F.substring(h, i, 8), 16, 10).cast("long") for i in (1, 9))
        nth = F.array_position(F.array(*map(F.lit, LEAPS)), x["y"] + YEAR) - 1
        # The number of leap years, 97, is prime.
        to = (nth * (step % (len(LEAPS) - 1) + 1) + start) % len(LEAPS)
        return F.struct(F.get(F.array(*map(F.lit, LEAPS)), to.cast("int")).alias("y"), F.lit(2).alias("mo"), F.lit(29).alias("d"))

    def show(x: Column) -> Column:
        # With or without leading zeros, as they were.
        wide = lambda c, i: F.lpad(c.cast("string"), F.length(F.element_at(text, i)), "0")
        sep = F.when(m.contains("/"), F.lit("/")).otherwise(F.lit("."))
        a, b = F.when(swapped, wide(x["mo"], 1)).otherwise(wide(x["d"], 1)), F.when(swapped, wide(x["d"], 2)).otherwise(wide(x["mo"], 2))
        return F.when(iso, F.concat_ws("-", wide(x["y"], 1), wide(x["mo"], 2), wide(x["d"], 3))).otherwise(F.concat(a, sep, b, sep, x["y"].cast("string")))

    new = F.transform(F.array(found), lambda x: F.when((x["mo"] == 2) & (x["d"] == 29), leap_day(x)).otherwise(moved(x)))
    return F.when(ok, F.transform(new, show)[0]).otherwise(m)


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(permute_text(local, key, "email"), F.substring(m, F.length(local) + 1, F.length(m)))


def _secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, r"[A-Za-z0-9_\-+/]{16,}$", 0)
    return F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(value)), permute_text(value, key, "secret", classes=SECRET_CLASSES))


MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "phone": _phone, "ssn": _ssn, "ip": _ip, "date": _date, "card": _card}


def pseudonym(match: Column, key: str) -> Column:
    """The pseudonym of one matched value; the value itself if it does not validate."""
    out = None
    for kind, pattern in PATTERNS:
        whole = match.rlike(f"^(?:{pattern})$")
        out = F.when(whole, MAKERS[kind](match, key)) if out is None else out.when(whole, MAKERS[kind](match, key))
    return out.otherwise(match)


def pseudonymised(df: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """Replaces ``text`` by its pseudonymised form; ``count``, if given, gets the values replaced.

    Null texts stay null with count 0; texts without personal data stay as they are, character by
    character. All other columns, also of clashing names, are kept; rows are kept, repeats too.
    """
    found, made, parts = (free_name(df, f"pii_{x}") for x in ("found", "made", "parts"))
    # The matches are computed once: most texts have none and go through untouched.
    some = F.when(F.col(text).rlike(NEEDED), F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0)))
    out = df.withColumn(found, some)
    out = out.withColumn(made, F.transform(F.col(found), lambda m: pseudonym(m, key)))
    out = out.withColumn(parts, F.when(F.size(found) > 0, F.split(F.col(text), PATTERN, -1)))
    joined = F.concat(F.array_join(F.zip_with(F.slice(parts, 1, F.size(found)), made, lambda a, b: F.concat(a, b)), ""), F.element_at(parts, -1))
    cols = []
    for c in df.columns:
        cols.append(F.when(F.size(F.col(found)) > 0, joined).otherwise(F.col(text)).alias(c) if c == text else F.col(f"`{c}`"))
    if count:
        changed = F.size(F.filter(F.arrays_zip(F.col(found).alias("a"), F.col(made).alias("b")), lambda z: z["a"] != z["b"]))
        cols.append(F.when(F.size(F.col(found)) > 0, changed).otherwise(0).cast("long").alias(count))
    return out.select(*cols)
