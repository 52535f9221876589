"""Exact and near duplicates against brute force."""

import hashlib
import itertools
import random
import re

import xxhash
from pyspark.sql import types as T

from shelfmark.llm import components, exact_dedup, simhash

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("component_id", T.StringType())])


def norm(t):
    return re.sub(r"[\x20\x09-\x0d]+", " ", t or "")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)


def texts():
    rnd = random.Random(5)
    base = [" ".join(rnd.choice("abcdefghij") * rnd.randint(1, 4) for _ in range(n)) for n in (1, 3, 60, 700)]
    rows = [(n, rnd.choice(base)) for n in range(40)]
    rows += [(50, None), (51, ""), (52, " "), (53, "\t\n "), (54, "a  b"), (55, "a\x0b\tb"), (56, "a b"), (57, "é" * 9000), (58, "é" * 9000 + "x")]
    rows += [(60, base[2]), (60, base[2]), (61, base[3] + "!"), (61, "other"), (None, "no id"), (None, "no id"), (None, base[1])]
    return rows


def test_exact_against_brute_force(spark):
    rows = texts()
    for size in (7, 16384):
        got = exact_dedup.exact_duplicates(docs(spark, rows), size=size).collect()
        assert len(got) == len(rows)
        groups = {}
        for i, t in rows:
            groups.setdefault(norm(t), []).append(i)
        by_sha = {hashlib.sha256(k.encode()).hexdigest(): (k, v) for k, v in groups.items()}
        for r in got:
            _, ids = by_sha[r.text_sha256]
            some = [i for i in ids if i is not None]
            assert r.keep_id == (min(some) if some else None) and r.group_size == len(ids)
        for sha, (_, ids) in by_sha.items():
            mine = [r for r in got if r.text_sha256 == sha]
            assert sorted(str(r.doc_id) for r in mine) == sorted(map(str, ids)) and sum(r.kept for r in mine) == 1
            assert all(r.doc_id == r.keep_id for r in mine if r.kept)


def test_exact_stage_and_empty(spark):
    rows = texts()
    df = docs(spark, rows)
    out = exact_dedup.drop_exact_duplicates(df)
    assert out.columns == df.columns
    assert out.count() == len({norm(t) for _, t in rows}) == len({norm(r.text) for r in out.collect()})
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0
    assert exact_dedup.drop_exact_duplicates(df.limit(0)).count() == 0


def test_clashing_hashes_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = F.xxhash64
    # Block hashes carry nothing then, so every name goes back by content.
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.length(c[0]).cast("long") if isinstance(c[0], str) and c[0] == "block" else real(*c))
    rows = [(1, "aaaa bbbb"), (2, "aaaa cccc"), (3, "aaaa bbbb"), (4, "bbbb aaaa")]
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_duplicates(docs(spark, rows), size=4).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}


def plain_fingerprint(t, words=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, distance):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= distance:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def test_fingerprints():
    for t in [None, "", " \t", "One", "one two THREE four", "É A b c d e É", "x " * 70000 + "y z", *[t for _, t in texts()]]:
        assert simhash.fingerprint_of(t) & (1 << 64) - 1 == plain_fingerprint(t)


def test_anchors_cover():
    rnd = random.Random(1)
    for width in (16, 21, 22):
        reach = simhash._reach(width)
        for _ in range(300):
            v = rnd.getrandbits(width)
            s = 0
            for i in range(15):
                s ^= (i + 1) * (v >> i & 1)
            home = v ^ (0 if s == 0 else 1 << (s - 1))
            u = v ^ (1 << rnd.randrange(width) if rnd.random() < 0.8 else 0)
            t = 0
            for i in range(15):
                t ^= (i + 1) * (u >> i & 1)
            assert home in {u ^ m for m in reach[t]}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_link_against_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    for _ in range(300):
        f = rnd.choice(fps)
        for _ in range(rnd.randint(1, 6)):
            f ^= 1 << rnd.randrange(64)
        fps.append(f)
    hot = rnd.getrandbits(64)  # a crowd round one point
    fps += [hot ^ (1 << rnd.randrange(12)) ^ (1 << rnd.randrange(64)) for _ in range(150)]
    fps = sorted(set(fps), key=signed)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for distance, crowd in ((0, 128), (4, 128), (4, 2), (7, 128)):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        want = {signed(f): signed(fps[r]) for f, r in zip(fps, brute_components(fps, distance), strict=True)}
        got = {r.fp: r.comp for r in simhash.link(df, distance).collect()}
        assert got == want, (distance, crowd)


def test_near_duplicates_of_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in df.collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    root = brute_components(fps, 4)
    want = {i: (f"{f:016x}", rows[r][0]) for (i, _), f, r in zip(rows, fps, root, strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == want
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {c for _, c in want.values()}


def test_near_duplicates_odd_rows(spark):
    rows = [(7, None), (3, ""), (5, " "), (9, "a b c d e"), (9, "a b c d e"), (None, "a b c d e"), (None, "zz yy xx ww"), (8, "A B C D E")]
    got = sorted(((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(docs(spark, rows)).collect()), key=str)
    assert got == sorted([("7", 3), ("3", 3), ("5", 3), ("9", 8), ("9", 8), ("None", 8), ("None", None), ("8", 8)], key=str)
    kept = sorted(str(r.doc_id) for r in simhash.drop_near_duplicates(docs(spark, rows)).collect())
    assert kept == ["3", "8", "None"]
    assert simhash.near_duplicates(docs(spark, rows).limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.comp for r in components.components(df).collect()} == {i: root(i) for i in parent}
    assert components.components(df.limit(0)).count() == 0


def smallest_reached(edges):
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: root(i) for i in up}


def test_components_by_star_steps(spark, monkeypatch):
    rnd = random.Random(4)
    edges = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7000 + i, 7000) for i in range(300)]
    edges += [(9000, 9300 + i) for i in range(50)] + [(-9, 9340), (5, 5), (None, 3), (3, None)]
    for kind, more in (("bigint", [(-(1 << 63), 9341), ((1 << 63) - 1, 7001)]), ("int", [])):
        df = spark.createDataFrame(edges + more, f"a {kind}, b {kind}")
        for most in (components.SMALL, 450, 0):  # one task at once, after some star steps, star steps to the end
            monkeypatch.setattr(components, "SMALL", most)
            out = components.components(df)
            assert out.dtypes == [("node", kind), ("comp", kind)]
            rows = out.collect()
            assert {r.node: r.comp for r in rows} == smallest_reached(edges + more)
            assert len(rows) == len({r.node for r in rows})
            monkeypatch.undo()


def tasks_of(spark, name, run):
    """How many tasks the driver handles for ``run()``."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    track = sc.statusTracker()
    stages = {s for j in track.getJobIdsForGroup(name) for s in track.getJobInfo(j).stageIds}
    return sum(i.numCompletedTasks for s in stages if (i := track.getStageInfo(s)))


def test_components_spare_the_driver(spark, monkeypatch):
    """The driver handles every task: short lists of edges take few, and no star step finds that nothing changed."""
    parts = 16
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long").repartition(parts)
    star = spark.createDataFrame([(i, 0) for i in range(1, 60)], "a long, b long").repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert tasks_of(spark, "short list", lambda: components.components(chain).count()) <= 5 * parts
        monkeypatch.setattr(components, "SMALL", 0, raising=False)
        assert tasks_of(spark, "stars", lambda: components.components(star).count()) <= 10 * parts
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
