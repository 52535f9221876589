"""Mixing against the contract: targets by plain iteration, the choice of documents by a plain walk."""

import random

import pytest
from pyspark.sql import types as T

from shelfmark.llm import mixing

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("source", T.StringType()), ("size", T.StringType()))])


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while True:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s] + 1e-9}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
        if not open_:
            return out


def plain_copies(docs, target):
    """Copies by uid of one source's documents ``(uid, size, u)``: the rule of the module, one by one."""
    copies = {uid: 0 for uid, _, _ in docs}
    can = [d for d in docs if 0 < d[1] <= target]
    total = sum(s for _, s, _ in can)
    if not total:
        return copies
    whole = min(2, int(target / total + 1e-12))
    rest = target - whole * total if whole < 2 else 0
    miss = rest - sum(s for _, s, _ in can if s <= rest)
    if whole == 1 and miss > 0:
        m = min(s for _, s, _ in can if s > rest)
        other = target - 2 * m
        reach = sum(s for _, s, _ in can if s <= other) - (m if m <= other else 0)
        if other >= 0 and max(0, other - reach) < miss:
            _, uid = min((u, uid) for uid, s, u in can if s == m)
            copies[uid], whole, rest = 2, 0, other
            can = [d for d in can if d[0] != uid]
    for uid, _, _ in can:
        copies[uid] = whole
    pool = [d for d in can if d[1] <= rest]
    while pool:  # inclusion probabilities in proportion to size; those that reach one are certain
        rate = rest / sum(s * s for _, s, _ in pool)
        top = max(s for _, s, _ in pool)
        if rate * top < 1:
            break
        for uid, s, _ in pool:
            if s == top:
                copies[uid] += 1
                rest -= s
        pool = [d for d in pool if d[1] < top]
    odds = lambda x: x / (1 - x)
    for uid, s, _ in sorted(pool, key=lambda d: (odds(d[2]) / odds(min(max(rate * d[1], 1e-15), 1 - 1e-15)), d[0])):
        if s <= rest:
            copies[uid] += 1
            rest -= s
    return copies


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rnd = random.Random(seed)
    sizes = {("s%d" % i if i else None): rnd.choice([0, 1, 10, 500, 100000]) for i in range(rnd.randint(1, 12))}
    if not sum(sizes.values()):
        sizes[None] = 3
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = plain_targets(sizes)
    for r in mixing.targets(df).collect():
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-6)


def rows():
    rnd = random.Random(4)
    out = [(i, "w " * rnd.choice([0, 1, 5, 40, 300]), rnd.choice(["a", "b", "B", "é", None]), "x") for i in range(3000)]
    out += [(4000 + i, "w " * int(rnd.paretovariate(0.8)), "long", "x") for i in range(500)]
    return [*out, (None, "a b", "a", "x"), (1, None, "a", "x"), (5, "one two", "b", "x"), (5, "one two", "b", "x"), (9000, "w " * 60000, "c", "x"), (9001, "", "d", "x"), (9002, "w " * 9000, "b", "x")]


@pytest.mark.parametrize("small,walk,share", [(10_000, 1024, 1.5), (1, 20, 0.4), (10_000, 20, 1.5)])
def test_mix_against_a_plain_walk(spark, monkeypatch, small, walk, share):
    monkeypatch.setattr(mixing, "SMALL", small)
    monkeypatch.setattr(mixing, "WALK", walk)
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).coalesce(1)
    own = mixing._documents(df, "doc_id", "text", "source", 42).collect()
    sizes = {}
    for r in own:
        sizes[r.src] = sizes.get(r.src, 0) + r.size
    want = plain_targets(sizes, share=share)
    got = mixing._mixed(df, "doc_id", "text", "source", share=share).collect()
    assert len(got) == len(data)
    copies, count = {}, {}
    for s in sizes:
        for uid, n in plain_copies([(r.uid, r.size, r.u) for r in own if r.src == s], want[s]).items():
            row = next(r.row for r in own if r.uid == uid)
            copies[row] = copies.get(row, 0) + n
    for r in got:
        assert r.source_size == sizes[r.src] and r.target == pytest.approx(want[r.src]) and r.copies in (0, 1, 2)
        count[r.row] = count.get(r.row, 0) + r.copies
    assert count == copies
    for s, target in want.items():
        mine = [r for r in got if r.src == s]
        gap = target - sum(r.copies * r.size for r in mine)
        assert gap >= -1e-6, s


def test_reruns_agree(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    again = mixing.mix(df.repartition(3)).select("doc_id", "size", "taken").collect()
    assert sorted(map(str, again)) == sorted(str(x) for x in mixing.mix(df).select("doc_id", "size", "taken").collect())


def test_rows_and_empty(spark):
    df = spark.createDataFrame(rows(), SCHEMA).withColumnRenamed("size", "a.b")
    out = mixing.mixed_rows(df)
    assert out.columns == [*df.columns, "copies", "taken"]
    assert sum(r.taken for r in out.collect()) == sum(r.taken for r in mixing.mix(df).collect())
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_rows(df.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(df.where("text = ''")).collect()} == {0}


def test_documents(spark, sf):
    got = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert sum(r.taken for r in own) <= own[0].target + 1e-6
        # Less is missing than any document that was not drawn.
        least = min(r.copies for r in own if r.size)
        assert own[0].target - sum(r.taken for r in own) <= min([r.size for r in own if r.size and r.copies == least < 2], default=1e-6)


@pytest.mark.parametrize("share,n,short", [(0.5, 1000, 300), (1.5, 20_000, 10), (1.2, 20_000, 10)])
def test_a_long_document_among_short_ones(spark, share, n, short):
    """A document as long as all others neither ends the mix early nor keeps it from its target."""
    data = [(i, "w " * short, "a", "x") for i in range(n)] + [(50_007, "w " * 300_000, "a", "x")]
    got = mixing.mix(spark.createDataFrame(data, SCHEMA), share=share).collect()
    assert len(got) == n + 1 and 0 <= got[0].target - sum(r.taken for r in got) < short


def test_sizes_raise_the_odds(spark):
    """Documents are drawn about as often as their inclusion probabilities say."""
    sizes = [50] * 4000 + [100] * 3000 + [200] * 2000
    df = spark.createDataFrame([(i, "w " * s, "a", "x") for i, s in enumerate(sizes)], SCHEMA)
    drawn = {50: 0, 100: 0, 200: 0}
    for r in mixing.mix(df, share=0.3).collect():
        drawn[r.size] += r.copies
    rate = 0.3 * sum(sizes) / sum(s * s for s in sizes)
    for s, k in drawn.items():
        assert k / sizes.count(s) == pytest.approx(rate * s, rel=0.12)
