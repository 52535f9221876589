"""Exact deduplication by deterministic block naming, with DataFrame functions only.

A text (white space normalised, as UTF-8) is cut into blocks of a fixed number of bytes. The
distinct blocks are sorted and their ranks become integer names; then adjacent pairs of names are
named in the same way, level by level, until each document has one name. Two documents have the
same name and level exactly if their texts are equal, as names come from sorted contents: no hash
collision can merge two texts. A 64-bit hash of a block is only used to carry its name back to the
rows without moving contents again, and only where all contents with that hash were seen to be
equal; rows of any other hash are joined by the content itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpoint, keep_rows, normal_space, row_key, shuffle_partitions

BLOCK_BYTES = 16384


def _ranked(distinct: DataFrame, order: list[str], bucket: Column, buckets: int) -> DataFrame:
    """Adds ``name``: the rank among the sorted rows of its bucket, numbered apart from other buckets."""
    b = distinct.withColumn("bucket", F.pmod(bucket, F.lit(buckets)).cast("long"))
    rank = F.row_number().over(W.partitionBy("bucket").orderBy(*order)).cast("long")
    return b.withColumn("name", F.col("bucket") + (rank - 1) * buckets)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """``key, idx, block, h``: one row for each block; an empty text has one empty block."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("norm") / F.lit(size)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("bytes"), i * size + 1, F.lit(size)))
    out = rows.select("key", F.col("norm").cast("binary").alias("bytes"), "norm")
    out = out.select("key", F.posexplode(cut).alias("idx", "block"))
    return out.select("key", F.col("idx").cast("long").alias("idx"), "block", F.xxhash64("block").alias("h"))


def identities(rows: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """``key, level, name`` for rows of ``key`` (not null) and ``norm`` (text, not null).

    Rows that share a key must have the same text; they give one row.
    """
    buckets = max(16, 4 * shuffle_partitions(rows.sparkSession))
    blocks = _blocks(rows, size)
    kinds = blocks.groupBy("h", "block").agg(F.lit(1).alias("one"))
    named = _ranked(kinds, ["h", "block"], F.col("h"), buckets)
    named = named.withColumn("kinds", F.count("*").over(W.partitionBy("bucket", "h")))
    named = named.select("h", "name", F.when(F.col("kinds") > 1, F.col("block")).alias("block"))
    named = checkpoint(named)
    alone, clash = named.where(F.col("block").isNull()), named.where(F.col("block").isNotNull())
    now = blocks.select("key", "idx", "h").join(alone.select("h", "name"), "h").select("key", "idx", "name")
    if not clash.isEmpty():
        now = now.unionByName(blocks.join(clash, ["h", "block"]).select("key", "idx", "name"))
    now = checkpoint(now.groupBy("key", "idx").agg(F.max("name").alias("name")))
    done, level = None, 0
    while True:
        last = now.groupBy("key").agg(F.max("idx").alias("last"), F.max("name").alias("name"))
        ended = last.where(F.col("last") == 0).select("key", F.lit(level).alias("level"), "name")
        done = ended if done is None else done.unionByName(ended)
        if now.where(F.col("idx") > 0).isEmpty():
            return done
        pair = now.groupBy("key", F.shiftright("idx", 1).alias("idx")).agg(
            F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(-1).cast("long")).alias("right"),
            F.max("idx").alias("was"),
        )
        # Documents of one block have their name already.
        open_ = pair.join(last.where(F.col("last") > 0).select("key"), "key", "left_semi")
        kinds = open_.select("left", "right").distinct()
        names = _ranked(kinds, ["left", "right"], F.xxhash64("left", "right"), buckets).select("left", "right", "name")
        now = checkpoint(open_.join(names, ["left", "right"]).select("key", "idx", "name"))
        level += 1


def _rows(df: DataFrame, id_col: str, text: str) -> DataFrame:
    # Rows of one id and one digest are taken for one text; the digest is part of the result anyway.
    t = F.coalesce(F.col(text), F.lit(""))
    norm = df.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text)).alias("row"), normal_space(t).alias("norm"))
    norm = norm.withColumn("sha", F.sha2("norm", 256))
    return norm.withColumn("key", F.concat_ws(":", F.col("sha"), F.col("id").cast("string")))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``df``: id, ``keep_id, group_size, kept, text_sha256``.

    Null texts count as empty, and all empty or blank-equal texts form one group. Of equal texts the
    row with the smallest id stays; null ids come last, so only a group without any id has a null
    ``keep_id``. Of rows that repeat id and text one is kept. Runs of ASCII white space count as one
    space. An empty table gives an empty one; other columns are ignored.
    """
    found = _groups(_rows(df, id_col, text), size)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")
    out = found.select("id", "keep_id", "group_size", "lead", "sha", copies)
    kept = F.col("lead") & (F.col("copy") == 1)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def _groups(rows: DataFrame, size: int) -> DataFrame:
    """One row per id and text: ``key, id, sha, row, n, keep_id, group_size, lead``."""
    name = identities(rows.select("key", "norm"), size)
    slim = rows.groupBy("key").agg(F.min("id").alias("id"), F.min("sha").alias("sha"), F.min("row").alias("row"), F.count("*").alias("n"))
    named = checkpoint(slim.join(name, "key"))
    group = named.groupBy("level", "name").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"), F.min("key").alias("low"))
    # Written out, so that both sides of the join are dealt anew and a large group's part can be split.
    out = named.join(checkpoint(group), ["level", "name"])
    # A group without ids: null ids of one text share their key.
    return out.withColumn("lead", F.col("id").eqNullSafe(F.col("keep_id")))


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``df`` that ``exact_duplicates`` keeps, with the columns of ``df``."""
    lead = _groups(_rows(df, id_col, text), size).where("lead")
    return keep_rows(df, lead.select(F.col("row").alias("key")), id_col, text)
