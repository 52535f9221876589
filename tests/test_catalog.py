"""Fixtures: search end to end, metadata, ingest, closure, incremental builds, publishing, streaming."""

import json
import lzma

import pytest
import zstandard
from pyspark.sql import functions as F

from shelfmark.catalog import Catalog
from shelfmark.operators import closure, commands, incremental, locate, metasearch, textindex
from shelfmark.plans.query import Field, LocateQuery, MetaQuery, MetaSort
from shelfmark.sources import evaluation, listings
from shelfmark.streaming import refresh

PKG = "pkg_id long, attr string, output string, toplevel boolean, system string, store_dir string, hash string, name string"
FILE = "pkg_id long, path string, kind string, size long, target string"
META = "meta_ord long, attr string, name string, description string, main_program string"


@pytest.fixture(scope="module")
def two(spark):
    packages = spark.createDataFrame([(0, "coreutils", "out", True, None, "/store", "1" * 32, "coreutils-9.11"), (1, "abuild", "out", False, None, "/store", "2" * 32, "abuild-1.0"), (2, "hello", "out", True, None, "/store", "3" * 32, "hello-2.12.3"), (3, "empty", "out", True, None, "/store", "4" * 32, "empty-1")], PKG)
    files = spark.createDataFrame([(i, p, "d", 1, None) for i in range(3) for p in ("", "/bin")] + [(0, "/bin/ls", "x", 100, None), (1, "/bin/ls", "s", 0, "ls"), (2, "/bin/hello", "x", 50, None), (2, "/share/bad\nname", "r", 1, None)], FILE)
    meta = spark.createDataFrame([(0, "coreutils", "coreutils", "GNU Core Utilities", None), (1, "abuild", "abuild", "Alpine build tools", "abuild"), (2, "hello", "hello", "A friendly greeting", "hello")], META)
    return packages, files, meta


def test_catalog(spark, two, tmp_path):
    path = str(tmp_path / "catalog")
    with pytest.raises(FileNotFoundError):
        Catalog.open(spark, path)
    Catalog.build(spark, path, *two)
    c = Catalog.open(spark, path)
    assert [r.label for r in c.locate(LocateQuery("ls", whole_name=True)).collect()] == ["coreutils.out"]
    assert [r.shown for r in c.which("ls").collect()] == ["coreutils.out", "(abuild.out)"]
    assert c.which("ls", False).count() == 1 and c.which("nothing").count() == 0
    assert [r.attr for r in c.search(MetaQuery("hello", Field.MAIN_PROGRAM)).collect()] == ["hello"]
    assert c.info("hello").first().description == "A friendly greeting" and c.info("Hello").count() == 0
    assert {r.name for r in c.stats().collect() if r.rows} >= {"packages", "files", "package_meta", "path_dict"}
    assert c.table("packages").count() == 3 and c.table("files").where("path like '%bad%'").count() == 0
    assert [r.attr for r in c.lookup("abuild", "out").collect()] == ["abuild"]
    before = c.version
    Catalog.build(spark, path, *two)
    assert Catalog.open(spark, path).version != before


def test_suggestions(spark, two):
    asked = spark.createDataFrame([("ls",), ("hello",), ("vi",)], "command string")
    provided = commands.providers(two[1], two[0])
    got = {r.command: (r.n, r.action, r.exit_code) for r in commands.suggest(provided, asked).collect()}
    assert got == {"ls": (2, "list", 127), "hello": (1, "tell", 127), "vi": (0, "none", 127)}
    auto = {r.command: (r.action, r.exit_code) for r in commands.suggest(provided, asked, "auto-run").collect()}
    assert auto == {"ls": ("refuse", 127), "hello": ("run", 0), "vi": ("none", 127)}
    with pytest.raises(ValueError):
        commands.suggest(provided, asked, "other")


def test_search_with_index_equals_scan(spark):
    names = [("hello-2.12", ["hello"], "/lib/hello.a"), ("coreutils-9.5", ["ls", "cat"], "/lib/libc.so"), ("grep-3.11", ["grep"], "/share/man/man1/grep.1")]
    rows = [(i, f"/bin/{t}", "x", 64472, None) for i, (_, tools, _) in enumerate(names) for t in tools + [f"tool{k}" for k in range(60)]]
    rows += [(i, p, "r", 64472, None) for i, (_, _, p) in enumerate(names)]
    files = spark.createDataFrame(rows, FILE)
    grams = textindex.path_trigrams(files.select("path").distinct())
    for pattern in "bin lib share hello grep man1 README /bin libc hello.a he".split():
        want = sorted((r.pkg_id, r.path) for r in files.where(F.col("path").contains(pattern)).collect())
        assert sorted((r.pkg_id, r.path) for r in textindex.indexed_search(files, grams, pattern).collect()) == want
    ids = {r.path: r.path_id for r in textindex.path_ids(files, 7).collect()}
    assert [ids[p] for p in sorted(ids)] == list(range(len(ids)))
    assert [r.pkg_id for r in textindex.prefix_packages(files, "/share/").collect()] == [2]


def meta_of(spark, rows):
    return spark.createDataFrame([(i, a, n or a, d, m) for i, (a, d, n, m) in enumerate(rows)], META)


def attrs(df):
    return [r.attr for r in df.collect()]


def test_metadata_search(spark):
    m = meta_of(spark, [("mise", None, None, None), ("mise-tool", None, None, None), ("other", "A mise manager", None, None), ("emise", None, None, None)])
    assert attrs(metasearch.search(m, MetaQuery("mise", Field.ATTR))) == ["mise", "mise-tool", "emise"]
    assert attrs(metasearch.search(m, MetaQuery("mise"))) == ["mise", "mise-tool", "emise", "other"]
    assert attrs(metasearch.search(m, MetaQuery("MISE", Field.ATTR, case_sensitive=True))) == []
    assert attrs(metasearch.search(m, MetaQuery("mise|other", Field.ATTR, regex=True, limit=2))) == ["mise", "other"]
    g = meta_of(spark, [("git", None, None, "git"), ("lazygit", None, None, "lazygit")])
    assert attrs(metasearch.search(g, MetaQuery("git", Field.MAIN_PROGRAM))) == ["git", "lazygit"]
    assert attrs(metasearch.search(g, MetaQuery("git", Field.MAIN_PROGRAM, exact=True))) == ["git"]
    s = meta_of(spark, [("alpha", None, "z-name", "alpha"), ("beta", None, "a-name", "beta"), ("gamma", None, "gamma", None)])
    by = lambda sort: attrs(metasearch.search(s, MetaQuery(".*", regex=True, sort=sort)))
    assert by(MetaSort.NAME) == ["beta", "gamma", "alpha"] and by(MetaSort.MAIN_PROGRAM) == ["gamma", "alpha", "beta"] and by(MetaSort.ATTR_DESC) == ["gamma", "beta", "alpha"]
    n = meta_of(spark, [("neovim-unwrapped", None, None, None), ("neovim-remote", None, None, None), ("vim", None, None, None)])
    assert set(attrs(metasearch.search(n, MetaQuery("nvim", fuzzy=True)))) == {"neovim-unwrapped", "neovim-remote"}
    assert metasearch.search(n, MetaQuery("nvim", fuzzy=True, limit=1)).count() == 1


def test_batch_and_rendering(spark, two):
    packages, files, meta = two
    q = LocateQuery("", all=True)
    got = sorted((r.pattern_no, r.attr, r.path) for r in locate.batch(files, packages, q, [" ls", "", "bin/hello", "zz"]).collect())
    assert got == [(0, "abuild", "/bin/ls"), (0, "coreutils", "/bin/ls"), (1, "hello", "/bin/hello")]
    assert locate.batch(files, packages, q, []).count() == 0
    row = json.loads(locate.json_lines(locate.enriched(locate.locate(files, packages, LocateQuery("hello")), meta)).first().line)
    assert row == {"attr": "hello.out", "size": 50, "type": "x", "path": "/bin/hello", "store_path": "/store/" + "3" * 32 + "-hello-2.12.3", "description": "A friendly greeting", "main_program": "hello"}
    full = meta.selectExpr("*", "'MIT' as license", "'https://x' as homepage", "array('m') as maintainers", "array('p') as platforms")
    row = json.loads(locate.json_lines(locate.enriched(locate.locate(files, packages, LocateQuery("hello")), full)).first().line)
    assert (row["license"], row["homepage"], row["maintainers"], row["platforms"]) == ("MIT", "https://x", ["m"], ["p"])
    least = locate.json_lines(locate.locate(files, packages, LocateQuery("bin/ls", minimal=True)), minimal=True)
    assert sorted(r.line for r in least.collect()) == ['{"attr":"(abuild.out)"}', '{"attr":"coreutils.out"}']


def test_evaluation_records(spark):
    job = lambda **k: json.dumps({"attr": "a", "name": "n-1", "system": "", "outputs": {"out": "/s/h-n", "doc": None, "bad": "x"}, **k})
    lines = [job(attrPath=["p", "q"], meta={"mainProgram": "m", "license": {"name": "N", "spdx-id": "S"}, "maintainers": ["x", {"name": "n", "email": "e"}, {"k": 1}, 3]}), '{"error":"e","fatal":false,"attr":"foo"}', "", "{bad", job(isCached=False), job(cacheStatus="local")]
    parsed = evaluation.records(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert parsed.count() == 5
    out = evaluation.outputs(parsed).collect()
    assert sorted((r.attr, r.output, r.system, r.main_program) for r in out) == [("a", "out", None, None), ("p.q", "out", None, "m")]
    meta = {r.attr: r for r in evaluation.metadata(parsed).collect()}
    assert meta["p.q"].license == "N" and meta["p.q"].maintainers == ["x", "n"]
    assert evaluation.license_of([1, "A", {"x": 1}, "B"]) == "A, B" and evaluation.license_of({"z": 1}) == '{"z":1}'
    t = [(True, "x", True), (None, "cached", True), (None, None, True), (False, None, False), (None, "other", False)]
    df = spark.createDataFrame(t, "c boolean, s string, want boolean")
    assert df.where(evaluation.available(F.col("c"), F.col("s")) != F.col("want")).count() == 0
    names = spark.createDataFrame([("foo;bar",), ("../x",), ("py.pkgs",)], "n string")
    assert [r.n for r in names.where(evaluation.valid_scope(F.col("n"))).collect()] == ["py.pkgs"]


def test_trees_and_references(spark, tmp_path):
    tree = {"root": {"type": "directory", "entries": {"bin": {"type": "directory", "entries": {"a": {"type": "regular", "executable": True, "size": 7}, "l": {"type": "symlink", "target": "a"}}}, "x": {"type": "regular"}}}}
    assert listings.flatten(json.dumps(tree)) == [("", "d", 2, None), ("/bin", "d", 2, None), ("/bin/a", "x", 7, None), ("/bin/l", "s", 0, "a"), ("/x", "r", 0, None)]
    deep = '{"type":"directory","entries":{"d":' * 70 + '{"type":"regular"}' + "}}" * 70
    for bad in ("{", deep, '{"type":"fifo"}', '{"type":"symlink"}', '{"type":"directory","entries":{"..":{"type":"regular"}}}', '{"type":"directory","entries":{"a/b":{"type":"regular"}}}', "[]"):
        with pytest.raises(listings.BadTree):
            listings.flatten(bad)
    df = spark.createDataFrame([("h", json.dumps(tree)), ("b", "{"), ("n", None)], "hash string, tree string")
    assert listings.file_rows(df).count() == 5 and listings.file_rows(df, prefix="/bin", exclude=("/bin/l",)).count() == 2
    info = f"StorePath: /s/x\nURL: nar/1.xz\nReferences: {'a' * 32}-one {'b' * 32}-two-2\n"
    refs = spark.createDataFrame([("k", info), ("bad", "References: short-x"), ("none", "URL: u")], "hash string, value string")
    got = {(r.hash, r.ok, r.dst_name, r.url) for r in listings.references(refs).collect()}
    assert got == {("k", True, "one", "nar/1.xz"), ("k", True, "two-2", "nar/1.xz"), ("bad", False, None, None), ("none", True, None, "u")}
    for name, data in (("a", zstandard.compress(b"x" * 50)), ("b", lzma.compress(b"y" * 50)), ("c", b"plain")):
        (tmp_path / name).write_bytes(data)
    got = {r.path[-1]: (r.tree, r.error) for r in listings.read_payloads(spark, str(tmp_path), 40).collect()}
    assert got["c"] == ("plain", None) and "too large" in got["a"][1] and "too large" in got["b"][1]
    spark.dataSource.register(listings.MirrorSource)
    rows = spark.read.format("mirror").option("path", str(tmp_path)).option("keys", "c\nzz").load().collect()
    assert {(r.key, r.status) for r in rows} == {("c", 200), ("zz", 404)}
    keys = spark.createDataFrame([("c",), ("zz",), ("c",)], "key string")
    assert {(r.key, r.status, r.body and bytes(r.body)) for r in listings.fetched(spark, str(tmp_path), keys).collect()} == {("c", 200, b"plain"), ("zz", 404, None)}


def test_closure_and_synthesis(spark):
    roots = spark.createDataFrame([("a", "A", "out", False, "n", None, 0), ("a", "B", "out", True, "n", "prog", 1), ("c", "C", "out", True, "n", "bad/x", 2), ("m", "M", "out", True, "n", "foo", 3)], "hash string, attr string, output string, toplevel boolean, name string, main_program string, ord long")
    refs = spark.createDataFrame([("a", "b", "n"), ("b", "b", "n"), ("b", "a", "n"), ("b", "d", "n"), ("x", "y", "n")], "src_hash string, dst_hash string, dst_name string")
    got = {r.hash: (r.attr, r.toplevel, r.main_program, r.is_root) for r in closure.closure(roots, refs).collect()}
    assert got == {"a": ("A", True, "prog", True), "b": ("", False, None, False), "d": ("", False, None, False), "c": ("C", True, "bad/x", True), "m": ("M", True, "foo", True)}
    assert closure.closure(roots, refs, deep=False).count() == 3 and closure.shallow(True, "/bin/") and not closure.shallow(True, None)
    status = spark.createDataFrame([("a", 200, 200), ("b", 404, 200), ("c", 404, 200), ("m", 200, 404), ("d", 500, 200)], "hash string, listing_status int, refs_status int")
    files = spark.createDataFrame([("a", "", "d", 0, None)], "hash string, path string, kind string, size long, target string")
    rows = sorted((r.hash, r.path) for r in closure.with_listings(closure.closure(roots, refs), files, status).collect())
    assert rows == [("a", ""), ("m", ""), ("m", "/bin"), ("m", "/bin/foo")]


def test_incremental(spark):
    cache = spark.sql("select 'k' as cache_key, 'h1' as hash, timestamp'2024-01-01' as fetched_at union all select 'k', 'h2', timestamp'2024-01-20' union all select 'o', 'h3', timestamp'2024-01-20'")
    now = F.lit("2024-01-21").cast("timestamp")
    assert [r.hash for r in incremental.fresh(cache, "k", now).collect()] == ["h2"] and incremental.fresh(cache, "k", now, 0).count() == 2
    assert incremental.upsert(cache, cache.where("hash = 'h1'")).count() == 3
    sizes = spark.createDataFrame([("a", 10), ("b", 5 << 20), ("c", 0)], "name string, total long")
    plan = incremental.segments(sizes, 3)
    rows = sorted(tuple(r) for r in plan.collect())
    assert rows[0] == ("a", 0, 0, 9) and [r[1] for r in rows[1:]] == [0, 1, 2] and rows[-1][3] == (5 << 20) - 1 and rows[2][2] == rows[1][3] + 1
    assert incremental.missing_segments(plan, plan.limit(2).select("name", "segment")).count() == 2
    data = bytes(range(256)) * 3000
    cuts = incremental.cut_points(data, 1000, 5000, 20000)
    assert cuts[-1] == len(data) and all(b - a <= 20000 for a, b in zip([0, *cuts], cuts, strict=False)) and incremental.cut_points(b"") == []
    shifted = incremental.chunks(spark.createDataFrame([("x", bytearray(b"zz" + data[:200000])), ("y", bytearray(data[:200000]))], "blob string, data binary"), 1000, 5000, 20000)
    back = incremental.reconstruct(shifted.drop("data"), shifted.select("hash", "data")).collect()
    assert {r.blob: (r.ok, len(r.data)) for r in back} == {"x": (True, 200002), "y": (True, 200000)}
    assert not any(r.ok for r in incremental.reconstruct(shifted.drop("data"), shifted.select("hash", "data").limit(0)).collect())


def test_republishing(spark, two, tmp_path):
    """New files make a new version; who opened the one before keeps it."""
    packages, files, meta = two
    source, path = tmp_path / "in", str(tmp_path / "catalog")
    source.mkdir()

    def rebuild(outputs):
        kept = packages.join(outputs.select("attr").distinct(), "attr", "left_semi").select(*packages.columns)
        return Catalog.build(spark, path, kept, files.join(kept, "pkg_id", "left_semi"), meta)

    seen = []
    for k, names in enumerate((["coreutils", "abuild"], ["hello"])):
        for a in names:
            (source / f"{a}.json").write_text(json.dumps({"attr": a, "outputs": {"out": f"/s/h-{a}"}}) + "\n")
        refresh.republish(spark, str(source), path, str(tmp_path / "ck"), rebuild).awaitTermination(120)
        seen.append(Catalog.open(spark, path))
        assert [c.table("packages").count() for c in seen] == [2, 3][: k + 1]
    refresh.republish(spark, str(source), path, str(tmp_path / "ck"), rebuild).awaitTermination(120)
    assert Catalog.open(spark, path).version == seen[-1].version


def test_streaming_refresh(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    line = lambda a: json.dumps({"attr": a, "outputs": {"out": f"/s/h-{a}"}})
    for k, names in enumerate((["a", "b"], ["c"])):
        (source / f"{k}.json").write_text("\n".join(map(line, names)) + "\n{bad\n")
        refresh.refresh(spark, str(source), target, str(tmp_path / "ck")).awaitTermination(60)
        assert spark.read.parquet(target).count() == 2 + k
    assert refresh.changed("a", "b") and not refresh.changed("a", "a") and refresh.changed("a", None)


def test_metadata_queries_build_no_files(spark, sf, monkeypatch):
    from shelfmark import queries

    monkeypatch.setattr(queries, "_built", {})
    monkeypatch.setattr(queries, "_recorded", {})
    own = lambda: {tuple(r) for r in queries.tables(spark, sf, "packages")[0].select("pkg_id", "attr", "output", "hash", "name").collect()}
    got = own()
    counts = {n: queries.QUERIES[n](spark, sf).count() for n in ("cache_upsert", "build_eval_only", "point_lookup")}
    assert not queries._built and len(queries._recorded) == 1
    queries.built(spark, sf)
    assert own() == got and {n: queries.QUERIES[n](spark, sf).count() for n in counts} == counts


def test_cut_points_follow_the_plain_sum():
    import random

    gear = incremental._gear()
    for n in (1, 2, 63, 64, 65, 5000):
        data = random.Random(n).randbytes(n)
        h = [sum(int(gear[data[i - age]]) << age for age in range(min(64, i + 1))) % 2**64 for i in range(n)]
        want, start = [], 0
        while n - start > 50:
            end, at = min(start + 900, n), None
            mid = min(start + 200, end)
            at = next((i for i in range(start + 50, mid + 1) if h[i - 1] >> 56 == 0), None)
            at = at or next((i for i in range(max(mid, start + 50), end + 1) if h[i - 1] >> 58 == 0), end)
            want.append(at)
            start = at
        assert incremental.cut_points(data, 50, 200, 900, gear) == want + [n] * (start < n)
