"""A catalog on disk: versioned tables, published by a pointer, with derived index tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as fn
from .operators import closure, commands, incremental, locate, metasearch, textindex
from .plans.query import Access, LocateQuery, MetaQuery, access_of, fixed_texts

TABLES = ("packages", "files", "package_meta")
INDEXES = ("path_entries", "command_providers", "basename_postings", "path_postings", "path_dict", "path_trigrams", "package_trigrams")
#: Candidate paths up to which they are handed to the scan as a list of values; more are joined.
LISTED = 1000


@dataclass(frozen=True)
class BuildOptions:
    """What a build records. ``include_prefix`` keeps and ``exclude_prefixes`` drop paths that start so;
    ``deep`` follows references (not if only programs are indexed); ``eval_only`` records metadata and
    packages without files; ``indexes`` names the index tables to write."""

    include_prefix: str | None = None
    exclude_prefixes: tuple[str, ...] = ()
    deep: bool = True
    eval_only: bool = False
    force: bool = False
    ttl: int = incremental.TTL
    indexes: tuple[str, ...] = INDEXES

    def __post_init__(self) -> None:
        if self.ttl < 0:
            raise ValueError("a time to live is not negative")
        if bad := set(self.indexes) - set(INDEXES):
            raise ValueError(f"unknown indexes: {sorted(bad)}")

    def kept(self, files: DataFrame) -> DataFrame:
        """Entries that can be recorded and that the prefixes let through."""
        out = files.where(fn.encodable(F.col("path")) & fn.encodable(F.col("target")))
        if self.include_prefix:
            out = out.where(F.col("path").startswith(self.include_prefix))
        for p in self.exclude_prefixes:
            out = out.where(~F.col("path").startswith(p))
        return out


@dataclass
class Counters:
    """What a build did."""

    indexed: int = 0
    failed: int = 0
    cached: int = 0
    entries: int = 0
    bytes_written: int = 0
    seconds: float = 0.0

    @property
    def packages_per_second(self) -> float:
        return self.indexed / self.seconds if self.seconds else 0.0


class _Folder:
    """Small files through Hadoop's file system, so any store that Spark reaches will do."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._p(self.path).getFileSystem(self.conf)

    def _p(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._p(f"{self.path}/{name}"))

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._p(f"{self.path}/{name}")).getLength()

    def delete(self, name: str) -> None:
        self.fs.delete(self._p(f"{self.path}/{name}"), True)

    def swap(self, name: str, text: str) -> None:
        """Writes a small file beside its place and renames it over in one step: a reader finds the old
        text or the new one, and a crash leaves one of them."""
        tmp, to = self._p(f"{self.path}/.{name}-{uuid.uuid4().hex}"), self._p(f"{self.path}/{name}")
        # A local folder without the checksum file, which would be renamed in a step of its own.
        local = self.fs.getScheme() == "file"
        fs = self.fs.getRawFileSystem() if local and hasattr(self.fs, "getRawFileSystem") else self.fs
        fs.mkdirs(self._p(self.path))
        out = fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if local:
            if not fs.rename(tmp, to):
                raise OSError(f"{to.toString()} cannot be replaced")
            return
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        self.jvm.java.lang.reflect.Array.set(how, 0, rename.OVERWRITE)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf)
        context.rename(fs.makeQualified(tmp), fs.makeQualified(to), how)


@dataclass
class Catalog:
    """Tables of one published version below ``path``. ``resident`` keeps tables that were read in
    executor memory; otherwise they are read anew for each query."""

    spark: SparkSession
    path: str
    version: str
    resident: bool = False
    counters: Counters | None = None
    _kept: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    @classmethod
    def open(cls, spark: SparkSession, path: str, resident: bool = False) -> Catalog:
        if not _Folder(spark, path).exists("current"):
            raise FileNotFoundError(f"no published catalog below {path}")
        version = spark.read.text(f"{path}/current").first()["value"]
        return cls(spark, path, version, resident)

    @classmethod
    def build(cls, spark: SparkSession, path: str, packages: DataFrame, files: DataFrame, meta: DataFrame, options: BuildOptions | None = None) -> Catalog:
        """Writes the tables and their indexes under a new version, then publishes it. Files are
        sorted by basename and path, so row-group statistics prune look-ups; packages without any
        entry are left out, but for builds of metadata only. ``counters`` tells what was written."""
        options, began = options or BuildOptions(), time.monotonic()
        made = cls(spark, path, f"v-{uuid.uuid4().hex}")
        kept = options.kept(files.where("false") if options.eval_only else files)
        made._sorted("files", kept, lambda f: f.withColumn("basename", fn.basename(F.col("path"))), "basename", "path")
        if not options.eval_only:
            packages = packages.join(made.table("files").select("pkg_id").distinct(), "pkg_id", "left_semi")
        packages.write.parquet(made._at("packages"))
        meta.write.parquet(made._at("package_meta"))
        made.build_indexes(() if options.eval_only else options.indexes)
        _Folder(spark, path).swap("current", made.version)
        size = _Folder(spark, path).size(made.version)
        # Both counts come from the files' footers.
        made.counters = Counters(made.table("packages").count(), entries=made.table("files").count(), bytes_written=size, seconds=time.monotonic() - began)
        return made

    @classmethod
    def ingest(
        cls,
        spark: SparkSession,
        path: str,
        roots: DataFrame,
        refs: DataFrame,
        listings: DataFrame,
        status: DataFrame,
        meta: DataFrame,
        options: BuildOptions | None = None,
        cached: DataFrame | None = None,
        previous: Catalog | None = None,
    ) -> Catalog:
        """A build from evaluated roots: closure of references, listings (synthetic where one is missing),
        tables and indexes. ``cached`` holds hashes of listings from the fetch cache and ``previous`` an
        earlier build: what both have counts as reused, unless the options force a refresh."""
        options = options or BuildOptions()
        deep = not closure.shallow(options.deep, options.include_prefix)
        found = closure.closure(roots, refs, deep)
        packages = textindex.numbered(found.withColumn("system", F.lit(None).cast("string")).withColumn("store_dir", F.lit("/store")), "pkg_id", "hash", "attr", "output")
        entries = closure.with_listings(packages, listings, status, deep).join(packages.select("hash", "pkg_id"), "hash").drop("hash")
        wanted = [f.name for f in packages.schema if f.name not in ("main_program", "is_root")]
        made = cls.build(spark, path, packages.select(*wanted), entries.select("pkg_id", "path", "kind", "size", "target"), meta, options)
        made.counters.failed = packages.count() - made.counters.indexed if not options.eval_only else 0
        if cached is not None and previous is not None and not options.force:
            before = previous.table("packages").select("attr", "output", "hash")
            made.counters.cached = incremental.reuse(made.table("packages"), before, cached).where("reused").count()
        return made

    def _at(self, name: str) -> str:
        return f"{self.path}/{self.version}/{name}"

    def _sorted(self, name: str, rows: DataFrame, shaped: Callable[[DataFrame], DataFrame], *key: str) -> None:
        """Writes a table by ranges of a key. Rows are written as they come first: the ranges are found from
        a pass of its own, which would compute them again. Rows of one key are dealt on by package."""
        staged = f"unsorted-{name}"
        rows.write.mode("overwrite").option("compression", "lz4").parquet(self._at(staged))
        d = shaped(self.spark.read.parquet(self._at(staged)))
        more = [c for c in ("pkg_id",) if c in d.columns and c not in key]
        d.repartitionByRange(*key, *more).sortWithinPartitions(*key).write.mode("overwrite").option("compression", "zstd").parquet(self._at(name))
        _Folder(self.spark, f"{self.path}/{self.version}").delete(staged)

    def table(self, name: str) -> DataFrame:
        if name not in self._kept or not self.resident:
            read = self.spark.read.parquet(self._at(name))
            self._kept[name] = read.cache() if self.resident else read
        return self._kept[name]

    def has(self, name: str) -> bool:
        return _Folder(self.spark, f"{self.path}/{self.version}").exists(name)

    def build_indexes(self, names: tuple[str, ...] = INDEXES) -> None:
        """Index tables from the version's files, each sorted by its key; metadata stays as it is."""
        files, packages = self.table("files").drop("basename"), self.table("packages")

        def write(name: str, rows: Callable[[], DataFrame], key: str) -> None:
            if name in names:
                rows().repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").option("compression", "zstd").parquet(self._at(name))

        write("path_entries", lambda: files, "path")
        write("command_providers", lambda: commands.providers(files, packages), "command")
        write("basename_postings", lambda: textindex.basename_postings(files), "basename")
        write("path_postings", lambda: textindex.path_postings(files), "path")
        write("path_dict", lambda: textindex.path_ids(files), "path")
        write("path_trigrams", lambda: textindex.path_trigrams(files.select("path").where("path <> ''").distinct()), "gram")
        write("package_trigrams", lambda: textindex.package_trigrams(files), "gram")

    def access(self, q: LocateQuery) -> Access:
        """The most specific access path whose index is there; the scan of all files always is."""
        wanted = access_of(q)
        needs = {Access.PATH: ("path_entries",), Access.TRIGRAMS: ("path_trigrams",), Access.PATHS: ("path_dict",)}.get(wanted, ())
        return wanted if all(map(self.has, needs)) else Access.SCAN

    def entries(self, q: LocateQuery, access: Access | None = None) -> DataFrame:
        """Entries among which all hits of a query are, by its access path."""
        access = access or self.access(q)
        if access is Access.PATH:
            return self.table("path_entries")  # the query's own predicates on the path prune it
        if access is Access.BASENAME:
            name = q.basename if q.basename is not None else q.pattern.rsplit("/", 1)[-1]
            return self.table("files").where(F.col("basename") == name).drop("basename")
        if access is Access.TRIGRAMS:
            texts = tuple(t for t in fixed_texts(q) if len(t.encode()) >= 3)
            return self._with_paths(textindex.candidate_paths(self.table("path_trigrams"), texts))
        if access is Access.PATHS:
            found = self.table("path_dict").select("path")
            for t in fixed_texts(q):
                found = found.where(F.col("path").contains(t))
            return self._with_paths(found)
        return self.table("files").drop("basename")

    def _with_paths(self, paths: DataFrame) -> DataFrame:
        """Entries of candidate paths: a short list goes to the scan, where it prunes; more are joined. Without
        the entries sorted by path, those sorted by basename are pruned by the list's basenames."""
        some = [r["path"] for r in paths.limit(LISTED + 1).collect()]
        by_path = self.has("path_entries")
        entries = self.table("path_entries" if by_path else "files")
        if len(some) > LISTED:
            entries = entries.join(paths, "path", "left_semi")
        elif not some:
            entries = entries.where("false")
        else:
            if not by_path:
                entries = entries.where(F.col("basename").isin(*{p.rsplit("/", 1)[-1] for p in some}))
            entries = entries.where(F.col("path").isin(*some))
        return entries.drop("basename")

    def packages(self, q: LocateQuery) -> DataFrame:
        """Packages that may have a hit: those with all trigrams of the query's literals."""
        texts = tuple(t for t in fixed_texts(q) if len(t.encode()) >= 3)
        if not texts or not self.has("package_trigrams"):
            return self.table("packages")
        return self.table("packages").join(textindex.candidate_packages(self.table("package_trigrams"), texts), "pkg_id", "left_semi")

    def locate(self, q: LocateQuery, access: Access | None = None) -> DataFrame:
        """The rows of a query, through the given access path or the one that fits it."""
        return locate.locate(self.entries(q, access), self.table("packages"), q)

    def batch(self, q: LocateQuery, patterns: list[str]) -> DataFrame:
        return locate.batch(self.table("files").drop("basename"), self.table("packages"), q, patterns)

    def search(self, q: MetaQuery) -> DataFrame:
        return metasearch.search(self.table("package_meta"), q)

    def info(self, attr: str) -> DataFrame:
        return metasearch.info(self.table("package_meta"), attr)

    def providers(self) -> DataFrame:
        return self.table("command_providers") if self.has("command_providers") else commands.providers(self.table("files"), self.table("packages"))

    def which(self, command: str, all_: bool = True) -> DataFrame:
        return commands.which(self.providers(), command, all_)

    def suggest(self, asked: DataFrame, mode: str = "message") -> DataFrame:
        return commands.suggest(self.providers(), asked, mode)

    def lookup(self, attr: str, output: str) -> DataFrame:
        """The package of a key; of several the last one written."""
        own = self.table("packages").where((F.col("attr") == attr) & (F.col("output") == output))
        return incremental.last_writes(own)

    def stats(self) -> DataFrame:
        """``name, bytes`` (null if missing) and ``rows`` of each table."""
        at, rows = _Folder(self.spark, f"{self.path}/{self.version}"), []
        for name in (*TABLES, *INDEXES):
            there = at.exists(name)
            rows.append((name, at.size(name) if there else None, self.table(name).count() if there else None))
        return self.spark.createDataFrame(rows, "name string, bytes long, rows long")

    def totals(self) -> DataFrame:
        """One row: ``entries, paths, packages, attrs``."""
        f = self.table("files").agg(F.count("*").alias("entries"), F.countDistinct("path").alias("paths"))
        p = self.table("packages").agg(F.count("*").alias("packages"), F.countDistinct("attr").alias("attrs"))
        return f.crossJoin(p)  # one row each
