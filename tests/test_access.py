"""Access paths: each gives the rows of the scan, reads what it should, and is chosen as it should."""

import threading

import pytest
from pyspark.sql import functions as F

from shelfmark.catalog import INDEXES, BuildOptions, Catalog, _Folder
from shelfmark.derived import derive
from shelfmark.operators import textindex
from shelfmark.plans.query import Access, LocateQuery, access_of

Q = LocateQuery


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    names = [("hello-2.12", ["hello"], "/lib/hello.a", "/share/doc/hello/README"), ("coreutils-9.5", ["ls", "cat"], "/lib/libc.so", "/share/man/man1/ls.1"), ("grep-3.11", ["grep"], "/lib/libgrep.a", "/share/man/man1/grep.1")]
    rows = [(i, f"/bin/{t}", "x", 64472, None) for i, (_, tools, *_) in enumerate(names) for t in tools + [f"tool{k}" for k in range(60)]]
    rows += [(i, p, "r", 64472, None) for i, (_, _, *ps) in enumerate(names) for p in ps] + [(0, "/bin/test", "x", 1, None), (0, "/bin/test_runner", "x", 1, None), (1, "/bin/tést", "x", 1, None), (1, "", "d", 1, None)]
    files = spark.createDataFrame(rows, "pkg_id long, path string, kind string, size long, target string")
    packages = spark.createDataFrame([(i, n.split("-")[0], "out", i < 2, None, "/store", str(i) * 32, n) for i, (n, *_) in enumerate(names)], "pkg_id long, attr string, output string, toplevel boolean, system string, store_dir string, hash string, name string")
    meta = spark.createDataFrame([(0, "hello", "hello", "d", None)], "meta_ord long, attr string, name string, description string, main_program string")
    return Catalog.build(spark, str(tmp_path_factory.mktemp("access") / "c"), packages, files, meta)


QUERIES = [
    *[Q(p, all=True, group=g) for p in "bin lib share hello grep man1 README /bin libc hello.a he é t".split() for g in (True, False)],
    Q("bin/.*test$", regex=True, all=True, group=False), Q("bin/t.*", regex=True), Q("b.n", regex=True, all=True), Q("(ls|cat)$", regex=True, all=True), Q("/share/.*1$", regex=True, all=True, group=False),
    Q("bin/ls", at_root=True, whole_name=True), Q("share/man", at_root=True, all=True, group=False), Q("man1/ls.1", whole_name=True, all=True), Q("ls", whole_name=True),
    Q("", basename="tool5", all=True), Q("bin", basename="tool5", all=True), Q("", path_prefix="/lib", all=True, group=False), Q("", labels=("grep.out",), all=True, group=False), Q("", all=True, group=False),
    Q("TEST", ignore_case=True, regex=True, all=True), Q("nothing-of-it", all=True), Q("bin/tool", minimal=True), Q("lib", package="grep", all=True),
]


@pytest.mark.parametrize("q", QUERIES, ids=lambda q: f"{q.pattern}-{q.regex}-{q.at_root}-{q.whole_name}-{q.group}-{q.basename}")
def test_access_paths_equal_the_scan(catalog, q):
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(catalog.locate(q)) == rows(catalog.locate(q, Access.SCAN))
    found = {r.pkg_id for r in catalog.locate(q, Access.SCAN).collect()} if not q.minimal else set()
    assert found <= {r.pkg_id for r in catalog.packages(q).select("pkg_id").collect()}


def test_choice(catalog):
    assert [access_of(q) for q in (Q("bin/ls", at_root=True), Q("", basename="x"), Q("bin/ls", whole_name=True), Q("lib"), Q("bin/.*test$", regex=True), Q("he"), Q("b.n", regex=True), Q(""), Q("lib", ignore_case=True, regex=True))] == [
        Access.PATH, Access.BASENAME, Access.BASENAME, Access.TRIGRAMS, Access.TRIGRAMS, Access.PATHS, Access.SCAN, Access.SCAN, Access.SCAN]
    bare = Catalog.build(catalog.spark, catalog.path + "-bare", catalog.table("packages"), catalog.table("files").drop("basename"), catalog.table("package_meta"), BuildOptions(indexes=()))
    assert bare.access(Q("lib")) is Access.SCAN and bare.locate(Q("lib/libc", all=True)).count() == 1 and bare.packages(Q("lib")).count() == 3
    bare.build_indexes(("path_trigrams", "path_entries"))
    assert bare.access(Q("lib")) is Access.TRIGRAMS and bare.which("ls").count() == 1
    pruned = catalog.packages(Q("libgrep")).collect()
    assert [r.attr for r in pruned] == ["grep"]


def _plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    return df._jdf.queryExecution().executedPlan().toString()


def test_predicates_reach_the_scan(catalog):
    path = _plan(catalog.locate(Q("/bin/ls", at_root=True, whole_name=True, all=True)))
    assert "EqualTo(path,/bin/ls)" in path and "path_entries" in path
    assert "StringStartsWith(path,/share/man)" in _plan(catalog.locate(Q("share/man", at_root=True, all=True, group=False)))
    assert "EqualTo(basename,tool5)" in _plan(catalog.locate(Q("", basename="tool5", all=True)))
    assert "StringContains(path,lib)" in _plan(catalog.locate(Q("lib", all=True), Access.SCAN))
    assert "In(gram, [" in _plan(textindex.candidate_paths(catalog.table("path_trigrams"), ("libgrep",)))
    assert "path_entries" in _plan(catalog.locate(Q("libgrep", all=True))) and "PushedFilters: [IsNotNull(path), EqualTo(path,/lib/libgrep.a)" in _plan(catalog.locate(Q("libgrep", all=True)))
    assert "EqualTo(command,ls)" in _plan(catalog.which("ls"))


def test_many_candidates_are_joined(catalog, monkeypatch):
    import shelfmark.catalog

    monkeypatch.setattr(shelfmark.catalog, "LISTED", 10)
    q = Q("bin/tool", all=True)
    assert catalog.locate(q).count() == catalog.locate(q, Access.SCAN).count() == 180


def test_build_options_and_counters(spark, catalog, tmp_path):
    files, packages, meta = catalog.table("files").drop("basename"), catalog.table("packages"), catalog.table("package_meta")
    made = Catalog.build(spark, str(tmp_path / "a"), packages, files, meta, BuildOptions(include_prefix="/bin/", exclude_prefixes=("/bin/tool", "/bin/test")))
    assert sorted(r.path for r in made.table("files").collect()) == ["/bin/cat", "/bin/grep", "/bin/hello", "/bin/ls", "/bin/tést"]
    c = made.counters
    assert (c.indexed, c.entries, c.failed) == (3, 5, 0) and c.bytes_written > 0 and c.packages_per_second > 0
    assert {r.name for r in made.stats().collect() if r.rows is not None} == {"packages", "files", "package_meta", *INDEXES}
    none = Catalog.build(spark, str(tmp_path / "b"), packages, files, meta, BuildOptions(include_prefix="/opt"))
    assert none.table("packages").count() == 0 and none.locate(Q("bin", all=True)).count() == 0
    only = Catalog.build(spark, str(tmp_path / "d"), packages, files, meta, BuildOptions(eval_only=True))
    assert only.table("packages").count() == 3 and only.table("files").count() == 0 and not only.has("path_trigrams") and only.info("hello").count() == 1
    resident = Catalog.open(spark, str(tmp_path / "a"), resident=True)
    assert resident.locate(Q("bin/ls")).count() == 1 and resident.table("path_entries").storageLevel.useMemory
    for bad in ({"ttl": -1}, {"indexes": ("other",)}):
        with pytest.raises(ValueError):
            BuildOptions(**bad)


def test_ingest(spark, tmp_path):
    roots = spark.createDataFrame([("a", "A", "out", True, "a-1", None, 0), ("m", "M", "out", True, "m-1", "foo", 1)], "hash string, attr string, output string, toplevel boolean, name string, main_program string, ord long")
    refs = spark.createDataFrame([("a", "b", "b-1"), ("b", "a", "a-1"), ("b", "d", "d-1")], "src_hash string, dst_hash string, dst_name string")
    files = spark.createDataFrame([(h, p, "x", 5, None) for h, p in (("a", "/bin/a"), ("b", "/lib/b"))], "hash string, path string, kind string, size long, target string")
    status = spark.createDataFrame([("a", 200, 200), ("b", 200, 200), ("m", 404, 200), ("d", 500, 200)], "hash string, listing_status int, refs_status int")
    meta = spark.createDataFrame([(0, "A", "a-1", "d", None)], "meta_ord long, attr string, name string, description string, main_program string")
    first = Catalog.ingest(spark, str(tmp_path / "c"), roots, refs, files, status, meta)
    assert sorted(r.path for r in first.table("files").collect()) == ["", "/bin", "/bin/a", "/bin/foo", "/lib/b"]
    assert (first.counters.indexed, first.counters.failed, first.counters.cached) == (3, 1, 0)
    cached = spark.createDataFrame([("a",), ("z",)], "hash string")
    again = Catalog.ingest(spark, str(tmp_path / "c"), roots, refs, files, status, meta, BuildOptions(include_prefix="/bin/"), cached, first)
    assert sorted(r.path for r in again.table("files").collect()) == ["/bin/a", "/bin/foo"] and again.counters.cached == 1
    forced = Catalog.ingest(spark, str(tmp_path / "c"), roots, refs, files, status, meta, BuildOptions(force=True), cached, first)
    assert forced.counters.cached == 0


def test_pointer_is_always_there(spark, tmp_path):
    """Readers in the middle of many swaps find one text or the other, never none."""
    folder, bad, stop = _Folder(spark, str(tmp_path)), [], threading.Event()
    folder.swap("current", "v-0")

    def read():
        while not stop.is_set():
            try:
                if not (tmp_path / "current").read_text().startswith("v-"):
                    bad.append("empty")
            except FileNotFoundError:
                bad.append("none")

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(200):
        folder.swap("current", f"v-{n}")
    stop.set()
    reader.join()
    assert not bad and (tmp_path / "current").read_text() == "v-199"


def test_candidate_paths_without_the_entries_by_path(catalog):
    bare = Catalog.build(catalog.spark, catalog.path + "-by-name", catalog.table("packages"), catalog.table("files").drop("basename"), catalog.table("package_meta"), BuildOptions(indexes=("path_trigrams", "path_dict")))
    rows = lambda df: sorted(map(str, df.collect()))
    for q, access in ((Q("libgrep", all=True), Access.TRIGRAMS), (Q("bin/tool", all=True), Access.TRIGRAMS), (Q("t", all=True, group=False), Access.PATHS), (Q("nothing-of-it", all=True), Access.TRIGRAMS)):
        assert bare.access(q) is access and rows(bare.locate(q)) == rows(catalog.locate(q, Access.SCAN))
    plan = _plan(bare.locate(Q("libgrep", all=True)))
    assert "EqualTo(basename,libgrep.a)" in plan and "EqualTo(path,/lib/libgrep.a)" in plan


def test_a_build_computes_its_rows_once(spark, catalog, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    files = catalog.table("files").drop("basename")
    made = Catalog.build(spark, str(tmp_path / "once"), catalog.table("packages"), files.mapInPandas(counted, files.schema), catalog.table("package_meta"), BuildOptions(indexes=()))
    assert seen.value == files.count() == made.counters.entries and not made.has("unsorted-files")


def test_files_are_made_as_their_sql_says(spark, tmp_path):
    """Odd rows: two names of one part, a name of one word, nulls, numbers below zero, parts without a name."""
    from shelfmark import derived

    part = [(1, "red rod", 1), (1, "red rod1", 1), (2, "red", 1), (3, None, 1), (4, "hot nested/rod", 1), (None, "a b", 1)]
    item = [(k, n, s, p) for k in (1, 2, 3, 4, None) for n in (-8, 0, 1, 6, 7, 13, None) for s in (-6, 0, 1, 5, 11, None) for p in (3.9, None, -0.5)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame(item, "l_partkey long, l_linenumber int, l_suppkey long, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    sql = derived.FILES
    for t in ("part", "lineitem"):
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}} AS {t}").replace(f"JOIN {t}", f"JOIN {{{t}}} AS {t}")
    want = spark.sql(sql, **{t: spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("part", "lineitem")})
    (got,) = derived.derive(spark, str(tmp_path), "files")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.dtypes == want.dtypes
    assert "SortAggregate" not in _plan(got)
