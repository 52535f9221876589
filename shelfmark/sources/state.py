"""What a build leaves for the next one: the fetch cache and the packages it recorded."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, _Folder
from ..operators import incremental
from ..schema import FETCH_CACHE

#: Layout of the cache; one of another layout is not read.
LAYOUT = 1


def save_cache(spark: SparkSession, path: str, cache: DataFrame) -> str:
    """Writes a fetch cache beside the one that is there, then swaps the pointer; readers see one or the other."""
    name = f"v-{uuid.uuid4().hex}"
    cache.withColumn("layout", F.lit(LAYOUT)).write.option("compression", "zstd").parquet(f"{path}/{name}")
    _Folder(spark, path).swap("current", name)
    return name


def load_cache(spark: SparkSession, path: str, key: str, now: Column | None = None, ttl: int = incremental.TTL) -> DataFrame:
    """Rows of the cache for a key that are not expired. A cache that is missing, of another layout or
    without the columns of one counts as empty: it is fetched anew."""
    empty = spark.createDataFrame([], FETCH_CACHE)
    folder = _Folder(spark, path)
    if not folder.exists("current"):
        return empty
    try:
        name = spark.read.text(f"{path}/current").first()["value"]
        found = spark.read.parquet(f"{path}/{name}")
    except AnalysisException:
        return empty
    if not {"layout", *empty.columns} <= set(found.columns):
        return empty
    rows = found.where(F.col("layout") == LAYOUT).select(*empty.columns)
    return incremental.fresh(rows, key, now if now is not None else F.current_timestamp(), ttl)


def previous_packages(spark: SparkSession, path: str) -> DataFrame | None:
    """``attr, output, hash`` of the build published at ``path``. None if there is none, or if what is there
    is something else; a catalog whose tables cannot be read is an error."""
    if not _Folder(spark, path).exists("current"):
        return None
    found = Catalog.open(spark, path)
    if not found.has("packages"):
        return None
    packages = found.table("packages")
    wanted = ("attr", "output", "hash")
    return packages.select(*wanted) if set(wanted) <= set(packages.columns) else None
