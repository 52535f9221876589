"""Inverted indexes over file paths, and searches that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as fn
from ..storage import cut


def postings(files: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """``key, pkg_id`` pairs, distinct; empty keys (the root's) have none."""
    return files.select(key.alias(name), "pkg_id").where(F.col(name) != "").distinct()


def basename_postings(files: DataFrame) -> DataFrame:
    return postings(files, fn.basename(F.col("path")), "basename")


def path_postings(files: DataFrame) -> DataFrame:
    return postings(files, F.col("path"), "path")


def document_frequency(pairs: DataFrame, key: str) -> DataFrame:
    return pairs.groupBy(key).agg(F.count("*").alias("df"))


def prefix_packages(files: DataFrame, prefix: str) -> DataFrame:
    return files.where(F.col("path").startswith(prefix)).select("pkg_id").distinct()


def basename_prefix_packages(files: DataFrame, prefix: str) -> DataFrame:
    return files.where(fn.basename(F.col("path")).startswith(prefix)).select("pkg_id").distinct()


def path_ids(files: DataFrame, parts: int | None = None) -> DataFrame:
    """``path_id, path``: dense ids from 0 in path order, without one task that sees all paths."""
    return numbered(files.select("path").where(F.col("path") != "").distinct(), "path_id", "path", parts=parts).select("path_id", "path")


def numbered(df: DataFrame, name: str, *order: str, parts: int | None = None) -> DataFrame:
    """Adds dense numbers from 0 in the order of some columns, which tell all rows apart.

    Rows are dealt by range and numbered in each part; the parts' offsets come from their counts.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    d = cut(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    local = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    sums = d.groupBy("part").agg(F.count("*").alias("n"))
    base = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("part", base.alias("base"))  # one row per part
    out = d.withColumn("nth", local).join(offsets, "part").withColumn(name, (F.col("base") + F.col("nth")).cast("long"))
    return out.drop("part", "nth", "base")


def path_trigrams(paths: DataFrame) -> DataFrame:
    """``gram, path`` pairs over a table of distinct paths."""
    return paths.select(F.explode(fn.trigrams(F.col("path"))).alias("gram"), "path")


def grams_of(literal: str) -> list[str]:
    raw = literal.encode()
    return sorted({raw[i : i + 3].hex().upper() for i in range(len(raw) - 2)})


def candidates(trigrams: DataFrame, literal: str) -> DataFrame:
    """Paths that hold all trigrams of a literal of three bytes or more; a superset of the hits."""
    grams = grams_of(literal)
    if not grams:
        raise ValueError("trigrams need three bytes")
    found = trigrams.where(F.col("gram").isin(*grams)).groupBy("path").agg(F.count("*").alias("n"))
    return found.where(F.col("n") == len(grams)).select("path")


def package_trigrams(files: DataFrame) -> DataFrame:
    """``gram, pkg_id`` pairs, distinct: which packages have a path with a trigram."""
    grams = files.select("pkg_id", "path").where(F.col("path") != "").select("pkg_id", F.explode(fn.trigrams(F.col("path"))).alias("gram"))
    return grams.select("gram", "pkg_id").distinct()


def candidate_packages(pairs: DataFrame, texts: tuple[str, ...]) -> DataFrame:
    """Packages that have all trigrams of all texts, in whatever paths: those in none are pruned."""
    grams = sorted({g for t in texts for g in grams_of(t)})
    if not grams:
        raise ValueError("trigrams need three bytes")
    found = pairs.where(F.col("gram").isin(*grams)).groupBy("pkg_id").agg(F.count("*").alias("n"))
    return found.where(F.col("n") == len(grams)).select("pkg_id")


def candidate_paths(trigrams: DataFrame, texts: tuple[str, ...]) -> DataFrame:
    """Paths that contain every text: candidates for each of three bytes or more are intersected (the
    index has one row per path and trigram, so one count does it), and all texts are verified."""
    grams = sorted({g for t in texts for g in grams_of(t)})
    if not grams:
        raise ValueError("trigrams need three bytes")
    found = trigrams.where(F.col("gram").isin(*grams)).groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
    for t in texts:
        found = found.where(F.col("path").contains(t))
    return found.select("path")


def union_packages(*parts: DataFrame) -> DataFrame:
    """Packages in any of several candidate sets."""
    out = parts[0].select("pkg_id")
    for p in parts[1:]:
        out = out.unionByName(p.select("pkg_id"))
    return out.distinct()


def named(pairs: DataFrame, packages: DataFrame) -> DataFrame:
    """Postings with the label of their package."""
    return pairs.join(packages.select("pkg_id", fn.label(F.col("attr"), F.col("output")).alias("label")), "pkg_id")


def entries_of(path_dict: DataFrame, entries: DataFrame, packages: DataFrame, path_ids_: DataFrame) -> DataFrame:
    """From path ids to the entries of these paths and on to their packages."""
    paths = path_dict.join(path_ids_.select("path_id"), "path_id", "left_semi").select("path")
    own = packages.select("pkg_id", fn.label(F.col("attr"), F.col("output")).alias("label"), fn.store_path(F.col("store_dir"), F.col("hash"), F.col("name")).alias("store_path"))
    return entries.join(paths, "path").join(own, "pkg_id").select("path", "label", "store_path", "kind", "size")


def indexed_search(files: DataFrame, trigrams: DataFrame, literal: str) -> DataFrame:
    """Entries whose path contains a literal: candidates from the index, each verified. A literal
    under three bytes is looked up in the distinct paths instead."""
    if len(literal.encode()) < 3:
        paths = files.select("path").where(F.col("path").contains(literal)).distinct()
    else:
        paths = candidates(trigrams, literal).where(F.col("path").contains(literal))
    return files.join(paths, "path", "left_semi")
