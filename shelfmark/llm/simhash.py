"""SimHash near-duplicates by anchor-point covering.

Fingerprints have 64 bits. They are cut into blocks so that two fingerprints within the distance
limit differ by at most one bit in some block. In each block the words of a Hamming code on 15 bits,
with the block's other bits free, are the anchors: every value lies within the covering radius 1 of
one anchor, its home. A fingerprint is sent to its home and to every anchor within covering radius
plus threshold (1 + 1), and each anchor compares its residents with its visitors. Pairs that differ
by at most one bit in a block therefore meet, so no link is lost. Of two values that differ by one bit
one has an odd number of bits: only such values are sent beyond their home.

Large groups of near copies would make an anchor compare all pairs. Before, each fingerprint is
sent to the 65 points within distance one of it: those that meet at a point (65 at most) lie within
two bits of each other and are linked to one of them, which joins dense groups at linear cost. Then
anchors only compare fingerprints of different groups, and where one group fills a crowded anchor,
its residents skip that group's visitors before the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, keep_rows, row_key, shuffle_partitions
from .components import components

HAMMING = 15
#: Shingles hashed at once, so that a very long text needs bounded memory.
CHUNK = 1 << 15
#: Crowded anchors up to which their list is broadcast; more are joined.
LISTED = 100_000
#: An anchor with this many residents of one group counts as crowded.
CROWD = 128


def fingerprint_of(text: str | None, words: int = 4) -> int:
    """The fingerprint of one text, as a signed 64-bit integer; 0 for null or no words."""
    import xxhash

    if not text:
        return 0
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(1, len(parts) - words + 1)
    starts, ends = starts[:n], ends[-n:]
    of, votes = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        pairs = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        h = np.array([of(joined[i:j], 42) for i, j in pairs], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", words: int = 4) -> DataFrame:
    """Adds the fingerprint column ``out`` (long). Null, empty and blank texts get 0; texts with
    fewer words than a shingle hash the whole sequence. Whole texts are read, in bounded chunks."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint_of(t, words) for t in batch], dtype="int64")

    return df.withColumn(out, of(F.col(text)))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def blocks_for(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of blocks such that ``distance`` differing bits leave one block with at most one."""
    n = max(2, (distance + 2) // 2)
    if not 0 <= distance <= 7:
        raise ValueError("distances from 0 to 7 are supported: a block needs 15 bits at least")
    cut = [round(64 * i / n) for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cut, cut[1:], strict=False)]


def _syndrome(value: Column) -> Column:
    """Which of the 15 code bits to flip to reach the Hamming code: 0 none, i the bit i - 1."""
    out = F.lit(0)
    for k in range(4):
        mask = sum(1 << i for i in range(HAMMING) if (i + 1) >> k & 1)
        parity = F.bit_count(value.bitwiseAND(F.lit(mask).cast("long"))).bitwiseAND(F.lit(1))
        out = out.bitwiseOR(F.shiftleft(parity, k))
    return out


def _flip(value: Column) -> Column:
    """The bit that leads from a value to its home."""
    return F.element_at(F.array(*[F.lit(0 if s == 0 else 1 << (s - 1)).cast("long") for s in range(16)]), _syndrome(value) + 1)


def _reach(width: int) -> list[list[int]]:
    """By syndrome: the bit patterns of weight two at most that lead to an anchor."""
    by: list[list[int]] = [[] for _ in range(16)]
    bits = range(width)
    masks = [0, *(1 << i for i in bits), *(1 << i | 1 << j for i in bits for j in range(i))]
    for m in masks:
        s = 0
        for i in range(HAMMING):
            s ^= (i + 1) * (m >> i & 1)
        by[s].append(m)
    return by


def _block(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _key(block: int, anchor: Column) -> Column:
    """One long for block and anchor; its lowest bit is left for the class of visitors."""
    return F.lit(block << 40).cast("long").bitwiseOR(F.shiftleft(anchor, 1))


def _homes(nodes: DataFrame, blocks: list[tuple[int, int]]) -> DataFrame:
    keys = []
    for n, (shift, width) in enumerate(blocks):
        v = _block(F.col("fp"), shift, width)
        keys.append(_key(n, v.bitwiseXOR(_flip(v))))
    return nodes.select("fp", "grp", F.explode(F.array(*keys)).alias("key"))


def _visits(nodes: DataFrame, blocks: list[tuple[int, int]]) -> DataFrame:
    out = None
    for n, (shift, width) in enumerate(blocks):
        v = _block(F.col("fp"), shift, width)
        masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in _reach(width)])
        # Of a pair that differs by one bit one has an odd number of bits, and its visits are enough; equal ones share their home.
        reach = F.when(F.bit_count(v) % 2 == 1, F.element_at(masks, _syndrome(v) + 1)).otherwise(F.array(_flip(v)))
        part = nodes.select("fp", "grp", v.alias("v"), F.explode(reach).alias("m"))
        part = part.select("fp", "grp", _key(n, F.col("v").bitwiseXOR(F.col("m"))).alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


def _dense_groups(fps: DataFrame) -> DataFrame:
    """Edges that join all fingerprints within two bits of each other, via the points between them."""
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("long")) for i in range(64)])
    met = fps.select("fp", F.explode(near).alias("point")).groupBy("point").agg(F.collect_list("fp").alias("all"))
    met = met.where(F.size("all") > 1).select("all", F.array_min("all").alias("b"))
    return met.select(F.explode("all").alias("a"), "b").where(F.col("a") != F.col("b"))


def link(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Groups distinct fingerprints: two are linked if at most ``distance`` bits differ.

    ``fps`` has a long column ``fp``; nulls and repeats are dropped. Returns ``fp, comp``, with
    ``comp`` the smallest fingerprint that is reachable. An empty table gives an empty table.
    """
    # Dealt evenly by number: what follows multiplies the rows, so few partitions would not do.
    parts = shuffle_partitions(fps.sparkSession)
    fps = checkpoint(fps.select("fp").where(F.col("fp").isNotNull()).distinct().repartition(parts, "fp"))
    dense = components(_dense_groups(fps)) if distance >= 2 else None
    nodes = fps.withColumn("grp", F.col("fp"))
    if dense is not None:
        nodes = fps.join(dense, fps.fp == dense.node, "left").select("fp", F.coalesce("comp", "fp").alias("grp"))
        nodes = checkpoint(nodes.repartition(parts, "fp"))
    blocks = blocks_for(distance)
    homes, visits = _split_crowds(_homes(nodes, blocks), _visits(nodes, blocks))
    u, v = homes.alias("u"), visits.alias("v")
    close = F.bit_count(F.col("u.fp").bitwiseXOR(F.col("v.fp"))) <= distance
    met = u.join(v, (F.col("u.key") == F.col("v.key")) & (F.col("u.grp") != F.col("v.grp")) & close)
    edges = met.select(F.greatest("u.grp", "v.grp").alias("a"), F.least("u.grp", "v.grp").alias("b"))
    top = components(edges)
    out = nodes.join(top, nodes.grp == top.node, "left")
    return out.select("fp", F.coalesce("comp", "grp").alias("comp"))


def _split_crowds(homes: DataFrame, visits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keeps the residents of a crowded anchor's largest group from the visitors of that group.

    Both tables hold ``key, grp`` and columns of their own; a key's lowest bit is free. At an anchor
    where one group has ``CROWD`` residents or more, that group's visitors get a key of their own
    (lowest bit set), to which only the other groups' residents go too. The result is the same with or
    without; pairs inside a group are linked already.
    """
    size = homes.groupBy("key", "grp").agg(F.count("*").alias("n")).where(F.col("n") >= CROWD)
    crowd = checkpoint(size.groupBy("key").agg(F.max_by("grp", F.struct("n", "grp")).alias("main")))
    many = crowd.limit(LISTED + 1).count()
    if not many:
        return homes, visits
    if many <= LISTED:  # a few megabytes: the visitors need not be dealt once more for it
        crowd = F.broadcast(crowd)
    own = F.col("grp").eqNullSafe(F.col("main"))
    rest = [c for c in homes.columns if c != "key"]
    h = homes.join(crowd, "key", "left")
    h = h.select(*rest, F.explode(F.when(F.col("main").isNull() | own, F.array("key")).otherwise(F.array("key", F.col("key") + 1))).alias("key"))
    v = visits.join(crowd, "key", "left").select(*rest, F.when(own, F.col("key") + 1).otherwise(F.col("key")).alias("key"))
    return h, v


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", distance: int = 4, words: int = 4) -> DataFrame:
    """One row per row of ``df``: id, ``fingerprint`` (hex), ``fp``, ``component_id``.

    ``component_id`` is the smallest id whose fingerprint is reachable over links of at most
    ``distance`` bits; ids that are null are never smallest (a component of null ids has a null id).
    Null and blank texts have fingerprint zero and are linked like any other. Repeated rows each
    give a row. An empty table gives an empty one. Other columns of ``df``, also of clashing names,
    are left out.
    """
    slim = _slim(df, id_col, text, words)
    out = slim.join(_labelled(slim, distance), "fp")
    return out.select(F.col("id").alias(id_col), hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def _slim(df: DataFrame, id_col: str, text: str, words: int) -> DataFrame:
    own = df.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text)).alias("key"), F.col(text).alias("text"))
    return checkpoint(fingerprints(own, "text", "fp", words).select("id", "key", "fp"))


def _labelled(slim: DataFrame, distance: int) -> DataFrame:
    """``fp, component_id`` for each distinct fingerprint."""
    first = slim.groupBy("fp").agg(F.min("id").alias("low")).join(link(slim.select("fp"), distance), "fp")
    first = checkpoint(first)
    low = first.groupBy("comp").agg(F.min("low").alias("component_id"))
    # Written out, so that both sides of the join are dealt anew and a large group's part can be split.
    return first.select("fp", "comp").join(checkpoint(low), "comp").select("fp", "comp", "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", distance: int = 4, words: int = 4) -> DataFrame:
    """Keeps one row of each component: a row with its smallest id.

    Columns are those of ``df``. Of rows that repeat this id in the component one stays; of a
    component whose ids are all null one row stays.
    """
    slim = _slim(df, id_col, text, words)
    lead = slim.join(_labelled(slim, distance), "fp").where(F.col("id").eqNullSafe(F.col("component_id")))
    return keep_rows(df, lead.groupBy("comp").agg(F.min("key").alias("key")), id_col, text)
