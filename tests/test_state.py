"""Fetch caches and earlier builds: what is missing, foreign or of another layout."""

import pytest
from pyspark.sql import functions as F

from shelfmark.catalog import BuildOptions, Catalog
from shelfmark.sources import state


def test_cache(spark, tmp_path):
    path, now = str(tmp_path / "cache"), F.lit("2024-01-21").cast("timestamp")
    load = lambda ttl=7 * 86400: sorted(r.hash for r in state.load_cache(spark, path, "k", now, ttl).collect())
    assert load() == []
    cache = spark.sql("select 'k' as cache_key, 'h1' as hash, array('a') as refs, '{}' as tree, timestamp'2024-01-01' as fetched_at union all select 'k', 'h2', array(), '{}', timestamp'2024-01-20' union all select 'o', 'h3', array(), '{}', timestamp'2024-01-20'")
    state.save_cache(spark, path, cache)
    assert load() == ["h2"] and load(0) == ["h1", "h2"]
    new = state.save_cache(spark, path, cache.where("hash = 'h1'"))
    assert load(0) == ["h1"]
    spark.range(3).write.mode("overwrite").parquet(f"{path}/{new}")  # something else
    assert load(0) == []
    cache.withColumn("layout", F.lit(99)).write.mode("overwrite").parquet(f"{path}/{new}")
    assert load(0) == []
    (tmp_path / "cache" / "current").write_text("v-gone")
    assert load(0) == []


def test_previous_build(spark, tmp_path):
    path = str(tmp_path / "c")
    assert state.previous_packages(spark, path) is None
    packages = spark.createDataFrame([(0, "a", "out", True, None, "/store", "h", "a-1")], "pkg_id long, attr string, output string, toplevel boolean, system string, store_dir string, hash string, name string")
    files = spark.createDataFrame([(0, "/bin/a", "x", 1, None)], "pkg_id long, path string, kind string, size long, target string")
    meta = spark.createDataFrame([(0, "a")], "meta_ord long, attr string")
    made = Catalog.build(spark, path, packages, files, meta, BuildOptions(indexes=()))
    assert [tuple(r) for r in state.previous_packages(spark, path).collect()] == [("a", "out", "h")]
    for part in (tmp_path / "c" / made.version / "packages").glob("*.parquet"):
        part.write_bytes(b"broken")
    with pytest.raises(Exception, match="(?i)parquet|footer|magic|read"):
        state.previous_packages(spark, path).collect()
    spark.range(2).write.mode("overwrite").parquet(f"{path}/{made.version}/packages")
    assert state.previous_packages(spark, path) is None
