"""Pseudonyms against plain Feistel networks, over every printed form of dates and several notations."""

import calendar
import datetime
import hashlib
import random
import re

import pytest

from shelfmark.llm import pii

KEY = "k"


def sha(parts, kind):
    return hashlib.new(kind, "|".join(map(str, parts)).encode()).hexdigest()


def plain_pair(a, b, ma, mb, kind):
    f = lambda x, tag, mod, k: int(sha((KEY, kind, tag, k, x), "sha256")[:12], 16) % mod
    for k in range(1, 5):
        a = (a + f(b, "a", ma, k)) % ma
        b = (b + f(a, "b", mb, k)) % mb
    return a, b


def plain_text(value, kind, classes=pii.CLASSES):
    a, b = value[: len(value) // 2], value[len(value) // 2 :]
    for k in range(1, 9):
        h, out = sha((KEY, kind, k, len(a), b), "sha512"), ""
        for i, c in enumerate(a):
            n = int(h[2 * (i % 64) :][:2], 16)
            lo, many = next((x for x in classes if x[0] <= ord(c) < sum(x)), (None, 0))
            out += c if lo is None else chr(lo + (ord(c) - lo + n) % many)
        a, b = b, out
    return a + b


def refill(shape, chars, slot):
    it = iter(chars)
    return "".join(next(it) if re.match(slot, c) else c for c in shape)


def plain_date(y, m, d):
    if (m, d) == (2, 29):
        leaps = [x for x in range(1800, 2200) if calendar.isleap(x)]
        h = sha((KEY, "leap"), "sha256")
        return leaps[(leaps.index(y) * (int(h[:8], 16) % 96 + 1) + int(h[8:16], 16)) % 97], 2, 29
    of = lambda day, month: (0 if day < 10 else 2 if day < 13 else 4) + (month > 9)
    year = [(x.month, x.day) for x in (datetime.date(2001, 1, 1) + datetime.timedelta(n) for n in range(365))]
    alike = [x for x in year if of(x[1], x[0]) == of(d, m)]
    *_, ma, mb = pii.DATES[of(d, m)]
    assert ma * mb == 400 * len(alike)
    a, b = plain_pair(*divmod((y - 1800) * len(alike) + alike.index((m, d)), mb), ma, mb, f"date{of(d, m)}")
    at, nth = divmod(a * mb + b, len(alike))
    return 1800 + at, *alike[nth]


FORMS = (
    lambda y, m, d: f"{y}-{m:02}-{d:02}",
    lambda y, m, d: f"{d:02}/{m:02}/{y}",
    lambda y, m, d: f"{d}.{m}.{y}",
    lambda y, m, d: f"{d:02}.{m}.{y}",
    lambda y, m, d: f"{m:02}/{d:02}/{y}" if d > 12 else None,
    lambda y, m, d: f"{m}/{d}/{y}" if d > 12 else None,
)


def replaced(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, pii_found string, `a.b` int")
    out = pii.pseudonymised(df, KEY, count="n")
    assert out.columns == ["doc_id", "text", "pii_found", "a.b", "n"]
    return [r.text for r in out.orderBy("doc_id").collect()]


def test_dates_in_every_form(spark):
    days = [datetime.date(y, 1, 1) + datetime.timedelta(n) for y in (1999, 2020) for n in range(366 if calendar.isleap(y) else 365)]
    days = [(x.year, x.month, x.day) for x in days]
    values = sorted({v for f in FORMS for x in days if (v := f(*x))})
    got = dict(zip(values, replaced(spark, values), strict=True))
    for x in days:
        to = plain_date(*x)
        assert datetime.date(*to)
        for f in FORMS:
            if v := f(*x):
                assert got[v] == f(*to), v
                assert re.sub(r"\d", "0", got[v]) == re.sub(r"\d", "0", v)
    assert len(set(got.values())) == len(values)


def test_each_kind_of_date_is_permuted():
    """The plain form is a permutation of all dates of a kind (days of 1 to 12 in October to December)."""
    days = [(y, m, d) for y in range(1800, 2200) for m in (10, 11, 12) for d in range(10, 13)]
    assert sorted(plain_date(*x) for x in days) == days
    leaps = [(y, 2, 29) for y in range(1800, 2200) if calendar.isleap(y)]
    assert sorted(plain_date(*x) for x in leaps) == leaps


def test_phones_are_linked_across_notations(spark):
    values = ["+1 555 123 4567", "+15551234567", "+1 (555) 123-4567", "(555) 123-4567", "555-123-4567", "+44 20 7946 0018", "+442079460018", "+44 (0)20 7946 0018", "+353 1 234 5678", "+35312345678"]
    got = replaced(spark, values)
    for v, g in zip(values, got, strict=True):
        code = next((c for c in ("+1", "+44", "+353") if v.startswith(c)), "")
        zero = "(0)" if "(0)" in v else ""
        digits = re.sub(r"[^0-9]", "", v[len(code) :].replace(zero, "", 1))
        shape = v.replace(zero, "@", 1)[len(code) :] if zero else v[len(code) :]
        assert g == code + refill(shape, plain_text(digits, "phone"), "[0-9]").replace("@", zero) != v


def luhn_digit(body):
    return next(c for c in "0123456789" if luhn(body + c))


def luhn(d):
    d = [int(x) for x in d][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


@pytest.mark.parametrize("lead,tail", [("", ""), ("pay (", ")."), ("x: ", " AND MORE 12")])
def test_cards_and_ibans_in_groups(spark, lead, tail):
    cards = ["371449635398431", "3714 496353 98431", "3714-496353-98431", "4111111111111111", "4111 1111 1111 1111", "30569309025904", "3056 930902 5904"]
    ibans = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "DE89-3704-0044-0532-0130-00", "GB82 WEST 1234 5698 7654 32", "AT61 1904 3002 3457 3201", "NO93 8601 1117 947"]
    got = replaced(spark, [lead + v + tail for v in cards + ibans])
    for v, g in zip(cards, got, strict=False):
        body = plain_text(re.sub(r"\D", "", v)[:-1], "card")
        assert g == lead + refill(v, body + luhn_digit(body), "[0-9]") + tail
    for v, g in zip(ibans, got[len(cards) :], strict=True):
        whole = re.sub("[ -]", "", v)
        body = plain_text(whole[4:], "iban")
        check = next(f"{n:02}" for n in range(2, 99) if int("".join(str(int(c, 36)) for c in body + whole[:2] + f"{n:02}")) % 97 == 1)
        assert g == lead + refill(v, whole[:2] + check + body, "[A-Z0-9]") + tail, v
    bad = ["DE88 3704 0044 0532 0130 00", "3714 496353 98432", "GB00 WEST 1234 5698 7654 32"]
    assert replaced(spark, bad) == bad


def test_secrets_numbers_and_addresses(spark):
    rnd = random.Random(3)
    tokens = ["".join(rnd.choice(a) for _ in range(24)) for a in ("0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz", "0123456789") for _ in range(20)]
    got = replaced(spark, [f'token = "{t}"' for t in tokens])
    for t, g in zip(tokens, got, strict=True):
        assert g == f'token = "{plain_text(t, "secret", pii.SECRET_CLASSES)}"'
        if set(t) <= set("0123456789abcdef"):
            assert set(g[9:-1]) <= set("0123456789abcdef")
    ssns = [f"{a:03}-{b:02}-{c:04}" for a in (1, 665, 667, 899) for b in (1, 99) for c in (1, 9999)]
    for v, g in zip(ssns, replaced(spark, ssns), strict=True):
        a, b, c = map(int, v.split("-"))
        x, y = plain_pair((a - 1 - (a > 666)) * 99 + b - 1, c - 1, 898 * 99, 9999, "ssn")
        area = x // 99 + 1
        assert g == f"{area + (area >= 666):03}-{x % 99 + 1:02}-{y + 1:04}"
    ips = [".".join(str(rnd.randrange(256)) for _ in range(4)) for _ in range(50)]
    for v, g in zip(ips, replaced(spark, ips), strict=True):
        o = [int(x) for x in v.split(".")]
        a, b = plain_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        assert g == f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    mails = ["und.34@mail7.example.com", "É.Ü9@x.org"]
    assert replaced(spark, mails) == [plain_text(m.split("@")[0], "email") + "@" + m.split("@")[1] for m in mails]


def test_very_long_text(spark):
    text = "plain words " * 200_000 + "call +1 555 123 4567 now"
    got = replaced(spark, [text, None, ""])
    assert got[0] == text.replace("555 123 4567", refill("555 123 4567", plain_text("5551234567", "phone"), "[0-9]")) and got[1:] == [None, ""]
