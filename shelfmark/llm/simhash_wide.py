"""Near copies by shingle similarity: SimHash of 256 bits, anchor-point covering in twelve blocks.

Two sets of shingles with Jaccard similarity J have fingerprints that differ in a share of
acos(2 J / (1 + J)) / pi of their bits; for J = 0.8 that is 39 of 256 bits, with a deviation of six.
Fingerprints only find candidates, up to ``DISTANCE`` bits apart, three deviations more; texts are linked
if their sets of shingles (64-bit hashes) have a similarity of ``SIMILAR`` or more. Candidates meet at anchors: words of
a Hamming code on 15 bits of a 21-bit block, the other bits free. A fingerprint has a home in each
block and visits every anchor within covering radius plus threshold, so pairs that differ by one bit
at most in some block meet; by simulation 96 of 100 pairs at J = 0.8 meet, 99 at 0.85, nearly all at
0.9. Twelve blocks take 252 of the 256 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, keep_rows, row_key, shuffle_partitions
from .components import components
from .simhash import CHUNK, _reach, _split_crowds, _syndrome

BITS, WORDS, WIDTH, BLOCKS, VIEW, VIEWS = 256, 5, 21, 12, 20, 30
#: Differing bits up to which a pair is a candidate.
DISTANCE = 57
#: Jaccard similarity from which texts are linked, as a fraction.
SIMILAR = (4, 5)
PARTS = ("f0", "f1", "f2", "f3")
#: What bounds the similarity of a text of a family; see ``_bounds``.
BOUNDS = ("size", "shared", "pivot", "lack")


def expected_distance(similarity: float) -> float:
    return BITS * math.acos(2 * similarity / (1 + similarity)) / math.pi


def shingles_of(text: str | None, words: int = WORDS) -> list[bytes]:
    """The distinct shingles of lower-cased words; a shorter text is one shingle."""
    parts = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not parts:
        return []
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(size + 1) - 1
    n = max(1, len(parts) - words + 1)
    starts, ends = (ends - size)[:n].tolist(), ends[-n:].tolist()
    return list({joined[i:j] for i, j in zip(starts, ends, strict=True)})


def fingerprint_of(text: str | None, words: int = WORDS) -> tuple[int, int, int, int]:
    """Four signed longs; zeros for null or no words."""
    import xxhash

    kinds = shingles_of(text, words)
    if not kinds:
        return (0, 0, 0, 0)
    of, votes = xxhash.xxh3_128_digest, np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(kinds), CHUNK):
        some = kinds[at : at + CHUNK]
        h = np.concatenate([np.frombuffer(b"".join([of(k, seed) for k in some]), dtype=np.uint8).reshape(-1, 16) for seed in (1, 2)], axis=1)
        votes += np.unpackbits(h, axis=1).sum(axis=0, dtype=np.int64)
    return tuple(np.packbits(2 * votes > len(kinds)).view("<i8").tolist())


def _fingerprints(df: DataFrame, words: int) -> DataFrame:
    @F.pandas_udf("f0 long, f1 long, f2 long, f3 long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([fingerprint_of(t, words) for t in batch], columns=list(PARTS), dtype="int64")

    return df.withColumn("f", of("text")).select("id", "key", "node", *[F.col(f"f.{p}").alias(p) for p in PARTS])


def _slice(start: int, width: int) -> Column:
    """Bits ``start .. start + width`` of the whole fingerprint, as a long."""
    word, at = divmod(start, 64)
    out = F.shiftrightunsigned(F.col(PARTS[word]), at)
    if at + width > 64:
        out = out.bitwiseOR(F.shiftleft(F.col(PARTS[word + 1]), 64 - at))
    return out.bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _apart(a: str, b: str) -> Column:
    out = None
    for p in PARTS:
        d = F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}")))
        out = d if out is None else out + d
    return out


def _stars(fps: DataFrame, distance: int) -> DataFrame:
    """Pairs ``x, y`` of a node that agrees in one of 30 views of 20 bits with the first of that view, and that
    one, if close enough: joins dense groups at linear cost before anchors compare what is left."""
    keys = F.array(*[F.lit(i << 32).cast("long").bitwiseOR(_slice(i * 8, VIEW)) for i in range(VIEWS)])
    seen = fps.select("node", *PARTS, F.explode(keys).alias("view"))
    first = checkpoint(seen.groupBy("view").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").select("view", "lead"))
    pairs = seen.select("node", "view").join(first, "view").where("node <> lead").select(F.col("node").alias("x"), F.col("lead").alias("y")).distinct()
    a, b = fps.alias("a"), fps.alias("b")
    near = pairs.join(a, F.col("x") == F.col("a.node")).join(b, F.col("y") == F.col("b.node"))
    return near.where(_apart("a", "b") <= distance).select("x", "y")


def meetings(nodes: DataFrame, distance: int) -> DataFrame:
    """Pairs ``x, y`` of nodes in different groups ``gx, gy`` whose fingerprints meet at an anchor and
    differ by ``distance`` bits at most. ``nodes`` holds ``node, grp, f0 .. f3``
    and the columns of ``_bounds``, size being 0 where they are not known. Where one group crowds an anchor, its
    residents and visitors do not meet."""
    cols = ["node", "grp", *BOUNDS, *PARTS]
    blocks = F.array(*[F.struct(F.lit(n << 32).cast("long").alias("block"), _slice(n * WIDTH, WIDTH).alias("v")) for n in range(BLOCKS)])
    cut = nodes.select(*cols, F.explode(blocks).alias("c")).select(*cols, "c.block", "c.v", _syndrome(F.col("c.v")).alias("s"))
    flip = F.when(F.col("s") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, s - 1)"))
    masks = F.expr("array(%s)" % ", ".join("array(%s)" % ", ".join(f"{m}L" for m in row) for row in _reach(WIDTH)))
    # Of a pair that differs by one bit one has an odd number of bits, and its visits are enough; equal ones share their home.
    odd = F.bit_count("v") % 2 == 1
    visits = cut.select(*cols, "block", "v", F.explode(F.when(odd, F.element_at(masks, F.col("s") + 1)).otherwise(F.array(flip))).alias("m"))
    key = lambda v: F.shiftleft(F.col("block").bitwiseOR(v), 1).alias("key")
    visits = visits.select(*cols, key(F.col("v").bitwiseXOR(F.col("m"))))
    homes, visits = _split_crowds(cut.select(*cols, key(F.col("v").bitwiseXOR(flip))), visits)
    u, v = homes.alias("u"), visits.alias("v")
    # What two texts share is at most what one shares with any, less what the other lacks of their pivot and it has.
    m, n = SIMILAR
    lacks = lambda a, b: F.when(F.col("u.pivot") == F.col("v.pivot"), F.bit_count(F.col(f"{a}.lack").bitwiseAND(F.bitwise_not(F.col(f"{b}.lack"))))).otherwise(0)
    most = F.least(F.col("u.shared") - lacks("v", "u"), F.col("v.shared") - lacks("u", "v"))
    may = (F.col("u.size") == 0) | (F.col("v.size") == 0) | ((m + n) * most >= m * (F.col("u.size") + F.col("v.size")))
    met = u.join(v, (F.col("u.key") == F.col("v.key")) & may & (F.col("u.grp") != F.col("v.grp")) & (_apart("u", "v") <= distance))
    return met.select(F.col("u.node").alias("x"), F.col("u.grp").alias("gx"), F.col("v.node").alias("y"), F.col("v.grp").alias("gy"))


def _sets(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """``node, s``: the hashed shingles of each text in a pair. Only these texts are read and dealt."""

    @F.pandas_udf("array<long>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import xxhash

        for batch in batches:
            yield pd.Series([np.array([xxhash.xxh3_64_intdigest(k) for k in shingles_of(t, words)], dtype=np.uint64).view(np.int64) for t in batch])

    ends = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    return checkpoint(texts.join(ends, "node", "left_semi").dropDuplicates(["node"]).select("node", hashed("text").alias("s")))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``pairs`` whose texts ``x, y`` have a similarity of ``SIMILAR`` or more; two texts without
    words are alike."""
    a, b = sets.select(F.col("node").alias("x"), F.col("s").alias("sx")), sets.select(F.col("node").alias("y"), F.col("s").alias("sy"))
    both, sizes = F.size(F.array_intersect("sx", "sy")), F.size("sx") + F.size("sy")
    m, n = SIMILAR
    return pairs.join(a, "x").join(b, "y").where(n * both >= m * (sizes - both)).select(*pairs.columns)


def _bounds(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """``node, size, shared, pivot, lack`` for each text in a pair of ``stars``.

    ``size`` counts its shingles and ``shared`` those that another text of ``sets`` has too. Texts that the
    pairs connect are a family, and its text with the smallest node is the ``pivot``; ``lack`` is a map of
    64 bits of the pivot's shared shingles that the text lacks: a bit is set if one that hashes to it is
    lacking. A bit set for one text and not for another stands for a shared shingle at least that only the
    other has.
    """
    alone = sets.select("node", F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    alone = alone.groupBy("node").agg(F.collect_list("h").alias("alone"))
    family = components(stars, "x", "y").select("node", F.col("comp").alias("pivot"))
    none = F.array().cast("array<long>")
    own = sets.join(family, "node").join(alone, "node", "left").select("node", "s", "pivot", F.coalesce("alone", none).alias("alone"))
    own = checkpoint(own)
    pivots = checkpoint(own.where("node = pivot").select("pivot", F.array_except("s", "alone").alias("p")))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    lack = F.aggregate(F.array_except("p", "s"), F.lit(0).cast("long"), lambda acc, h: acc.bitwiseOR(bit(h)))
    shared = F.size("s") - F.size("alone")
    return own.join(pivots, "pivot").select(F.col("node").alias("n1"), F.size("s").alias("size"), shared.alias("shared"), "pivot", lack.alias("lack"))


def link(fps: DataFrame, texts: DataFrame, distance: int = DISTANCE, words: int = WORDS) -> DataFrame:
    """``node, comp`` for each node of ``fps`` (``node, f0 .. f3``); ``comp`` names the group. ``texts``
    holds ``node, text``.

    Texts that agree in a view with its first text are compared first. Members of a family of texts have
    such partners; what a text shares with none of them, and what it lacks of the family's pivot, bounds
    its similarity to each, so members that are too far apart are not paired at the anchors.
    """
    parts = shuffle_partitions(fps.sparkSession)
    fps = checkpoint(fps.select("node", *PARTS).distinct().repartition(parts, "node"))
    stars = checkpoint(_stars(fps, distance))
    sets = _sets(stars, texts, words)
    dense = components(_confirmed(stars, sets), "x", "y").withColumnRenamed("node", "n2")
    nodes = fps.join(dense, F.col("node") == F.col("n2"), "left").join(_bounds(stars, sets), F.col("node") == F.col("n1"), "left")
    known = [F.coalesce(c, F.lit(0)).alias(c) for c in BOUNDS]
    nodes = checkpoint(nodes.select("node", *PARTS, F.coalesce("comp", "node").alias("grp"), *known).repartition(parts, "node"))
    met = meetings(nodes, distance)
    swap = F.col("x") > F.col("y")
    met = met.select(*[F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("x", "y"), ("y", "x"), ("gx", "gy"), ("gy", "gx"))])
    met = checkpoint(met.distinct())
    top = components(_confirmed(met, _sets(met, texts, words)), "gx", "gy").withColumnRenamed("node", "n3").withColumnRenamed("comp", "top")
    return nodes.join(top, F.col("grp") == F.col("n3"), "left").select("node", F.coalesce("top", "grp").alias("comp"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text: str = "text", distance: int = DISTANCE, words: int = WORDS) -> DataFrame:
    """Of each group of linked texts the row with the smallest id, with the columns of ``df``.

    Null and blank texts form one group. Null ids come last; of rows that repeat id and text one
    stays. An empty table gives an empty one.
    """
    texts = df.select(F.xxhash64(F.col(text)).alias("node"), F.col(text).alias("text"))
    own = df.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text)).alias("key"), F.xxhash64(F.col(text)).alias("node"), F.col(text).alias("text"))
    slim = checkpoint(_fingerprints(own, words))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    by_node = slim.groupBy("node").agg(first)
    lead = by_node.join(link(slim, texts, distance, words), "node").groupBy("comp").agg(F.min("first").alias("first"))
    return keep_rows(df, lead.select(F.col("first.key").alias("key")), id_col, text)
