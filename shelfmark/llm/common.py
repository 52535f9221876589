"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One run of ASCII white space, and one word, as the contracts define them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Matches only the runs of white space that are not already one plain space.
UNEVEN_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    It is read from the session. Only a purely local session (tests) without that setting gets a
    temporary folder; on a cluster its absence is an error, as no machine-local folder would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="shelfmark-checkpoint-")
    sc.setCheckpointDir(made)
    return made


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def normal_space(text):
    """Each run of ASCII white space becomes one space; null stays null."""
    return F.regexp_replace(text, UNEVEN_SPACE, " ")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def row_key(id_col, text):
    """A string that tells rows apart by id and text; repeated rows share it, nulls are allowed."""
    return F.concat_ws(":", F.hex(F.xxhash64(text)), id_col.cast("string"))


def keep_rows(df: DataFrame, keep: DataFrame, id_col: str, text: str) -> DataFrame:
    """The rows of ``df`` whose ``row_key`` is in ``keep.key``, one of those that share a key.

    One exchange of the rows; columns are those of ``df``.
    """
    key = free_name(df, "row_key")
    keyed = df.withColumn(key, row_key(F.col(id_col), F.col(text)))
    hit = keyed.join(keep.select(F.col("key").alias(key)), key, "left_semi")
    return hit.dropDuplicates([key]).drop(key)
