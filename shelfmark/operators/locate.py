"""File search over ``files`` and ``packages``."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as fn
from ..plans.query import FileSort, LocateQuery, file_predicate, package_predicate, path_predicate

RESULT = ("pkg_id", "attr", "output", "label", "toplevel", "hash", "name", "store_path", "path", "kind", "size", "target")


def hits(files: DataFrame, packages: DataFrame, q: LocateQuery, carried: tuple[str, ...] = ()) -> DataFrame:
    """Entries that a query finds, with their package; unordered and without limit. ``carried`` names
    further columns of ``files`` to keep.

    File predicates are pushed to the scan of ``files``, package predicates to that of ``packages``;
    the join is left to the optimizer, which broadcasts packages while they are small.
    """
    p = packages.where(package_predicate(q, F.col("name"), F.col("hash"), F.col("toplevel"), fn.label(F.col("attr"), F.col("output"))))
    p = p.select("pkg_id", "attr", "output", "toplevel", "store_dir", "hash", "name")
    found = files.where(file_predicate(q, F.col("path"), F.col("kind"), F.col("size"))).join(p, "pkg_id")
    out = found.withColumn("label", fn.label(F.col("attr"), F.col("output")))
    return out.withColumn("store_path", fn.store_path(F.col("store_dir"), F.col("hash"), F.col("name"))).select(*RESULT, *carried)


def _ordered(df: DataFrame, sort: FileSort) -> DataFrame:
    tail = ["pkg_id", "path"]
    lead = {FileSort.SIZE_ASC: ["size"], FileSort.SIZE_DESC: [F.desc("size")], FileSort.ATTR_ASC: ["attr"]}.get(sort, [])
    return df.orderBy(*lead, *tail)


def locate(files: DataFrame, packages: DataFrame, q: LocateQuery) -> DataFrame:
    """The rows of a query in its order. A minimal query gives distinct labels as they are shown, in
    order of their first entry; its limit counts labels."""
    found = hits(files, packages, q)
    if q.minimal:
        shown = fn.shown_label(F.col("attr"), F.col("output"), F.col("toplevel"))
        first = found.withColumn("label", shown).groupBy("label").agg(F.min(F.struct("pkg_id", "path")).alias("first"))
        out = first.orderBy("first").select("label")
        return out if q.limit is None else out.limit(q.limit)
    if q.limit is None:
        return found if q.sort is FileSort.NONE else _ordered(found, q.sort)
    return _ordered(found, q.sort).limit(q.limit)


def count(files: DataFrame, packages: DataFrame, q: LocateQuery) -> DataFrame:
    """One row with the number of results, after the limit if there is one."""
    return locate(files, packages, q).agg(F.count("*").alias("n"))


def batch(files: DataFrame, packages: DataFrame, q: LocateQuery, patterns: list[str]) -> DataFrame:
    """Several patterns with one set of options: rows of ``locate`` with ``pattern_no, pattern``.

    Patterns are trimmed and blank ones dropped. One scan serves all: each pattern is a predicate of
    its own, and an entry gets the list of the patterns that it fits. If the query is one by regular
    expression, each pattern is one, used as it is: anchors and whole names do not apply to it.
    """
    kept = [p.strip() for p in patterns if p.strip()]
    if q.regex:
        q = replace(q, at_root=False, whole_name=False)
    one = replace(q, pattern="", regex=False, package=None, minimal=False, limit=None, sort=FileSort.NONE, group=False)
    if not kept:
        return hits(files, packages, one).where("false").withColumn("pattern_no", F.lit(0)).withColumn("pattern", F.lit(""))
    each = [q.with_pattern(p) for p in kept]
    fits = F.array(*[F.when(file_predicate(x, F.col("path"), F.col("kind"), F.col("size")), F.lit(i)) for i, x in enumerate(each)])
    any_ = None
    for x in each:
        p = path_predicate(x, F.col("path"))
        any_ = p if any_ is None else any_ | p
    cand = files.where(any_).withColumn("pattern_no", F.explode(F.array_compact(fits)))
    names = F.element_at(F.array(*[F.lit(p) for p in kept]), F.col("pattern_no") + 1)
    if q.package is not None:
        packages = packages.where(package_predicate(replace(q, pattern="", all=True), F.col("name"), F.col("hash"), F.col("toplevel")))
    return hits(cand, packages, one, ("pattern_no",)).withColumn("pattern", names)


#: What metadata adds to a result.
META = ("description", "license", "homepage", "maintainers", "platforms", "main_program")


def enriched(results: DataFrame, meta: DataFrame) -> DataFrame:
    """Left join to the first metadata record of each attribute, whatever its case."""
    key = F.lower("attr")
    first = meta.withColumn("attr_lc", key).withColumn("nth", F.row_number().over(W.partitionBy("attr_lc").orderBy("meta_ord")))
    first = first.where("nth = 1").select("attr_lc", *[c for c in META if c in meta.columns], F.col("name").alias("meta_name"))
    out = results.withColumn("attr_lc", key).join(first, "attr_lc", "left")
    return out.drop("attr_lc")


def json_lines(results: DataFrame, minimal: bool = False) -> DataFrame:
    """One JSON object per row; fields that are null are left out. ``attr`` is the label as the text
    output shows it; links have no size."""
    if minimal:
        return results.select(F.to_json(F.struct(F.col("label").alias("attr"))).alias("line"))
    shown = fn.shown_label(F.col("attr"), F.col("output"), F.col("toplevel")).alias("attr")
    size = F.when(F.col("kind") == "s", F.lit(0).cast("long")).otherwise(F.col("size")).alias("size")
    more = [c for c in META if c in results.columns]
    return results.select(F.to_json(F.struct(shown, size, F.col("kind").alias("type"), "path", "store_path", *more)).alias("line"))


def text_lines(results: DataFrame) -> DataFrame:
    shown = fn.shown_label(F.col("attr"), F.col("output"), F.col("toplevel"))
    return results.select(fn.text_line(shown, F.col("size"), F.col("kind"), F.col("path")).alias("line"))
