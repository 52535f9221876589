"""Near copies by five-word similarity."""

import itertools
import random

from pyspark.sql import types as T

from shelfmark.llm import simhash_wide as wide

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("comp", T.StringType())])


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_distance_follows_similarity():
    rnd = random.Random(1)
    for _ in range(20):
        words = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(400)]
        other = list(words)
        for k in rnd.sample(range(400), 8):
            other[k] = "zz%d" % k
        a, b = " ".join(words), " ".join(other)
        j = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        d = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(wide.fingerprint_of(a), wide.fingerprint_of(b), strict=True))
        assert abs(d - wide.expected_distance(j)) < 26


def test_copies_go_and_others_stay(spark):
    rnd = random.Random(2)
    text = lambda n: ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(n)]
    rows, groups = [], []
    for g in range(60):
        base = text(rnd.choice([60, 120, 400]))
        own = [base]
        for _ in range(2):
            copy = list(base)
            copy[rnd.randrange(len(copy))] = "edited"
            own.append(copy)
        groups.append([len(rows) + k for k in range(3)])
        rows += [(len(rows) + k, " ".join(w), "x") for k, w in enumerate(own)]
    base = text(150)  # a crowd of near copies
    crowd = []
    for _ in range(300):
        copy = list(base)
        copy[rnd.randrange(150)] = rnd.choice("pqrst") * 3
        crowd.append(len(rows))
        rows.append((len(rows), " ".join(copy), "x"))
    half = [(len(rows), " ".join(base[:75] + text(75)), "x")]  # shares half of its words only
    odd = [(5000, None, "x"), (5001, "", "x"), (5001, "", "x"), (None, " ", "x"), (None, "a b", "x"), (6000, "a", "x")]
    df = spark.createDataFrame(rows + half + odd, SCHEMA)
    out = wide.drop_near_copies(df)
    assert out.columns == df.columns
    kept = {r.doc_id for r in out.collect()}
    left = [sum(i in kept for i in g) for g in groups]
    assert sum(left) <= 62 and all(left) and {g[0] for g in groups} <= kept
    assert sum(i in kept for i in crowd) == 1 and half[0][0] in kept
    assert {5000, 6000, None} <= kept and 5001 not in kept
    assert wide.drop_near_copies(df.limit(0)).count() == 0


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id for r in wide.drop_near_copies(df).collect()}
    rows = sorted((r.doc_id, r.text) for r in df.collect())
    sets = {i: shingles(t) for i, t in rows if len(t) < 20000}
    gone = [i for i, _ in rows if i not in kept]
    best = lambda i: max(len(sets[i] & sets[k]) / len(sets[i] | sets[k]) for k in sets if k != i)
    # What goes has a partner at 0.8 or more, and of the pairs at 0.8 or more nine of ten at least are caught.
    assert gone and all(best(i) >= 0.8 for i in gone if i in sets)
    pairs = [(i, k) for i, k in itertools.combinations(sets, 2) if 5 * len(sets[i] & sets[k]) >= 4 * len(sets[i] | sets[k])]
    assert pairs and sum(i in kept and k in kept for i, k in pairs) <= 0.1 * len(pairs)


def test_crowds_do_not_change_meetings(spark, monkeypatch):
    from shelfmark.llm import simhash

    rnd, rows = random.Random(9), []
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    for g in range(3):
        base = rnd.getrandbits(256)
        for k in range(40):
            bits = base ^ sum(1 << b for b in rnd.sample(range(256), 3)) if k else base
            rows.append((len(rows), g if k % 5 else 100 + len(rows), *[signed(bits >> 64 * w & (1 << 64) - 1) for w in range(4)]))
    nodes = spark.createDataFrame(rows, "node long, grp long, f0 long, f1 long, f2 long, f3 long").selectExpr("*", "0 as size", "0 as shared", "0L as pivot", "0L as lack")
    met = lambda: {(min(r.x, r.y), max(r.x, r.y)) for r in wide.meetings(nodes, 20).collect()}
    plain = met()
    monkeypatch.setattr(simhash, "CROWD", 4)
    assert met() == plain and len(plain) > 500


def test_last_bits_make_anchors(spark):
    """Fingerprints that differ by five bits in each of the first eight blocks, by one in the others."""
    flips = [21 * b + k for b in range(8) for k in range(16, 21)] + [187, 206, 225, 244]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rnd, rows = random.Random(3), []
    for _ in range(20):
        f = rnd.getrandbits(256)
        for bits in (f, f ^ sum(1 << k for k in flips)):
            rows.append((len(rows), len(rows), *[signed(bits >> 64 * w & (1 << 64) - 1) for w in range(4)]))
    nodes = spark.createDataFrame(rows, "node long, grp long, f0 long, f1 long, f2 long, f3 long").selectExpr("*", "0 as size", "0 as shared", "0L as pivot", "0L as lack")
    got = {(min(r.x, r.y), max(r.x, r.y)) for r in wide.meetings(nodes, len(flips)).collect()}
    assert got == {(2 * k, 2 * k + 1) for k in range(20)}


def test_threshold_is_exact(spark):
    """Around 0.8: what is linked has that similarity, and pairs that have it are linked but for a few that do not meet."""
    rnd, rows, above, below = random.Random(5), [], [], []
    for k in range(400):
        words = ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(300)]
        other = words[: rnd.choice([266, 267, 268, 269])]
        other += ["z" + "".join(rnd.choices("abcdefghij", k=6)) for _ in range(300 - len(other))] if k % 2 else []
        if not k % 2:
            other = words[: rnd.choice([240, 241, 242, 243])]  # 236 of 296 shingles fall short, 237 do not
        a, b = shingles(" ".join(words)), shingles(" ".join(other))
        (above if 5 * len(a & b) >= 4 * len(a | b) else below).append(len(rows) + 1)
        rows += [(len(rows), " ".join(words), "x"), (len(rows) + 1, " ".join(other), "x")]
    kept = {r.doc_id for r in wide.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(above) > 100 and len(below) > 40 and all(i in kept for i in below)
    assert sum(i in kept for i in above) <= 0.08 * len(above)


def test_bounds_hold_and_leave_few(spark):
    """A family by random edits of one text: no similar pair is ruled out, and few others are left."""
    rnd, rows = random.Random(11), []
    base = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(150)]
    for _ in range(200):
        copy = list(base)
        for at in rnd.sample(range(150), rnd.choice([1, 2, 3, 4])):
            copy[at] = "".join(rnd.choices("klmnop", k=4))
        rows.append((len(rows), " ".join(copy)))
    texts = spark.createDataFrame(rows, "node long, text string")
    pairs = spark.createDataFrame([(i, 0 if i % 2 else i - 1) for i in range(1, 200)], "x long, y long")
    got = {r.n1: r for r in wide._bounds(pairs, wide._sets(pairs, texts, 5)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    assert len(got) == 200 and {r.pivot for r in got.values()} == {0} and all(r.size == len(sets[i]) for i, r in got.items())
    left = similar = 0
    for i, k in itertools.combinations(range(200), 2):
        a, b = got[i], got[k]
        most = min(a.shared - (b.lack & ~a.lack & (1 << 64) - 1).bit_count(), b.shared - (a.lack & ~b.lack & (1 << 64) - 1).bit_count())
        both = len(sets[i] & sets[k])
        assert both <= most
        left += 9 * most >= 4 * (a.size + b.size)
        similar += 9 * both >= 4 * (a.size + b.size)
    assert similar <= left <= 1.5 * similar
