"""Package-evaluation records and package metadata in NDJSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..schema import EVAL, META_WIRE

LICENSE_KEYS = ("spdx-id", "fullName", "name")
MAINTAINER_KEYS = ("email", "github", "name")


def records(lines: DataFrame) -> DataFrame:
    """Parses a column ``value`` of lines: ``raw`` and ``job`` (null if a line cannot be read); blank
    lines are dropped. Works on a stream too."""
    kept = lines.where(F.trim("value") != "")
    job = F.from_json("value", EVAL + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = kept.select(F.col("value").alias("raw"), job.alias("job"))
    return out.withColumn("job", F.when(F.col("job._bad").isNull() & F.col("job.attr").isNotNull(), F.col("job")))


def succeeded(job: Column) -> Column:
    return job["error"].isNull() & ~F.coalesce(job["fatal"], F.lit(False))


def available(is_cached: Column, status: Column) -> Column:
    """Cached, or reported as cached or local, or not reported at all."""
    known = F.coalesce(is_cached, F.lit(False)) | F.coalesce(status.isin("cached", "local"), F.lit(False))
    return known | (is_cached.isNull() & status.isNull())


def _first_key(o: dict, keys) -> str | None:
    return next((v for k, v in o.items() if k in keys and isinstance(v, str)), None)


def license_of(value) -> str | None:
    """A string as it is; of an object the first known key in document order; of a list its strings."""
    if value is None:
        return None
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        found = _first_key(value, LICENSE_KEYS)
        return found if found is not None else json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    if isinstance(value, list):
        return ", ".join(x for x in value if isinstance(x, str))
    return json.dumps(value)


def maintainers_of(value) -> list[str]:
    out = [x if isinstance(x, str) else _first_key(x, MAINTAINER_KEYS) if isinstance(x, dict) else None for x in value or []] if isinstance(value, list) else []
    return [x for x in out if x is not None]


def _untyped(raw: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """License and maintainers of raw records; they depend on the order of keys in the document."""
    for batch in raw:
        rows = []
        for line in batch:
            try:
                meta = json.loads(line).get("meta") or {}
            except (ValueError, AttributeError):
                meta = {}
            rows.append((license_of(meta.get("license")), maintainers_of(meta.get("maintainers"))))
        yield pd.DataFrame(rows, columns=["license", "maintainers"])


def untyped_meta(raw: Column) -> Column:
    return F.pandas_udf(_untyped, "license string, maintainers array<string>")(raw)


def attribute(job: Column) -> Column:
    return F.when(F.size(job["attrPath"]) > 0, F.array_join(job["attrPath"], ".")).otherwise(job["attr"])


def outputs(parsed: DataFrame) -> DataFrame:
    """A row per store path of the jobs that succeeded and are available; nulls and what is no store
    path are dropped. The main program goes with the output ``out`` only."""
    job = F.col("job")
    ok = job.isNotNull() & succeeded(job) & available(job["isCached"], job["cacheStatus"])
    rows = parsed.where(ok).select(attribute(job).alias("attr"), job.alias("job"), F.explode(job["outputs"]).alias("output", "store"))
    rows = rows.where("store is not null").withColumn("p", fn.parse_store_path(F.col("store"))).where("p is not null")
    main = F.when(F.col("output") == "out", F.col("job.meta.mainProgram"))
    system = F.when(F.col("job.system") != "", F.col("job.system"))
    return rows.select("attr", "output", F.lit(True).alias("toplevel"), system.alias("system"), F.col("p.dir").alias("store_dir"), "p.hash", "p.name", main.alias("main_program"))


def metadata(parsed: DataFrame) -> DataFrame:
    """Metadata records of the jobs that succeeded."""
    job = F.col("job")
    rows = parsed.where(job.isNotNull() & succeeded(job)).withColumn("u", untyped_meta(F.col("raw")))
    return rows.select(
        attribute(job).alias("attr"), F.col("job.name").alias("name"), F.col("job.meta.description").alias("description"),
        F.col("job.meta.mainProgram").alias("main_program"), "u.license", F.col("job.meta.homepage").alias("homepage"), "u.maintainers",
        F.col("job.meta.platforms").alias("platforms"),
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata NDJSON; blank lines are skipped, any bad line fails the read."""
    d = spark.read.schema(META_WIRE).option("mode", "FAILFAST").json(path)
    return d.withColumnRenamed("mainProgram", "main_program")


def write_metadata(meta: DataFrame, path: str) -> None:
    meta.withColumnRenamed("main_program", "mainProgram").write.mode("overwrite").json(path)


SCOPE = r"^[A-Za-z_][A-Za-z0-9_'.-]*$"


def valid_scope(name: Column) -> Column:
    return name.rlike(SCOPE) & ~name.contains("..")


def union_scopes(root: DataFrame, scopes: dict, selected: bool = False) -> DataFrame:
    """Root records and those of extra scopes. A scope is a function that gives a DataFrame; one that
    fails is left out, as are names that are no scope. With a selection of its own only root counts."""
    import re

    out = root
    for name, read in scopes.items():
        if selected or not re.match(SCOPE, name) or ".." in name:
            continue
        try:
            out = out.unionByName(read())
        except Exception as e:  # a scope that cannot be read is no failure of the build
            print(f"scope {name} is left out: {type(e).__name__}")
    return out
