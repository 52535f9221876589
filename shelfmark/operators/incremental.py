"""Caches, reuse of earlier builds, download segments, and content-defined chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as fn

TTL = 7 * 24 * 3600
SEGMENT = 1 << 20
#: Bytes of chunks that are put out at once.
PUT_OUT = 4 << 20


def fresh(cache: DataFrame, key: str, now: Column, ttl: int = TTL) -> DataFrame:
    """Cache rows of a key that are not expired; a time to live of 0 never ends."""
    out = cache.where(F.col("cache_key") == key)
    return out if ttl == 0 else out.where(now.cast("long") - F.col("fetched_at").cast("long") <= ttl)


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace those of the same key and hash."""
    return cache.join(new, ["cache_key", "hash"], "left_anti").unionByName(new)


def reuse(packages: DataFrame, previous: DataFrame, cached: DataFrame) -> DataFrame:
    """Marks packages whose label and hash an earlier build had and whose listing is cached."""
    p = packages.withColumn("label", fn.label(F.col("attr"), F.col("output")))
    before = previous.select(fn.label(F.col("attr"), F.col("output")).alias("label"), "hash").distinct().withColumn("was", F.lit(True))
    have = cached.select("hash").distinct().withColumn("have", F.lit(True))
    out = p.join(before, ["label", "hash"], "left").join(have, "hash", "left")
    return out.withColumn("reused", F.coalesce(F.col("was") & F.col("have"), F.lit(False))).drop("was", "have")


def last_writes(packages: DataFrame) -> DataFrame:
    """Of the packages with one attribute and output, the last one written."""
    w = W.partitionBy("attr", "output").orderBy(F.desc("pkg_id"))
    return packages.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def segments(sizes: DataFrame, most: int, least: int = SEGMENT) -> DataFrame:
    """``name, segment, first_byte, last_byte`` (inclusive): contiguous ranges of even size, at most
    ``most`` for a file and none under ``least`` bytes but for a smaller file's only one."""
    n = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col("total") / least))).cast("long")
    out = sizes.where("total > 0").select("name", "total", n.alias("n"))
    out = out.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("segment"))
    at = lambda k: F.floor(F.col("total") * k / F.col("n")).cast("long")
    return out.select("name", "segment", at(F.col("segment")).alias("first_byte"), (at(F.col("segment") + 1) - 1).alias("last_byte"))


def missing_segments(planned: DataFrame, done: DataFrame) -> DataFrame:
    return planned.join(done, ["name", "segment"], "left_anti")


def _gear() -> np.ndarray:
    """256 fixed 64-bit numbers, from a digest of the byte."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([i])).digest()[:8], "big") for i in range(256)], dtype=np.uint64)


def cut_points(data: bytes, least: int = 4096, usual: int = 65536, most: int = 262144, gear: np.ndarray | None = None) -> list[int]:
    """Ends of content-defined chunks: a rolling gear hash decides, within the size limits, with a
    harder condition before the usual size than after it."""
    n = len(data)
    if not n:
        return []
    gear, raw = _gear() if gear is None else gear, np.frombuffer(data, dtype=np.uint8)
    bits = max(1, usual.bit_length() - 1)
    # The hash of a window of 64 bytes: gear values shifted by their age. Windows are doubled six times, from one byte on.
    h, width = gear[raw], 1
    with np.errstate(over="ignore"):
        while width < min(64, n):
            older = h[: n - width] << np.uint64(width)
            h[width:] += older
            width *= 2
    top = lambda k: (h >> np.uint64(64 - k)) == 0
    hard, soft = np.flatnonzero(top(bits + 1)) + 1, np.flatnonzero(top(max(1, bits - 1))) + 1
    out, start = [], 0
    while n - start > least:
        end = min(start + most, n)
        mid = min(start + usual, end)
        i = np.searchsorted(hard, start + least)
        if i < len(hard) and hard[i] <= mid:
            at = int(hard[i])
        else:
            j = np.searchsorted(soft, max(mid, start + least))
            at = int(soft[j]) if j < len(soft) and soft[j] <= end else end
        out.append(at)
        start = at
    if start < n:
        out.append(n)
    return out


def chunks(blobs: DataFrame, least: int = 4096, usual: int = 65536, most: int = 262144) -> DataFrame:
    """``blob, idx, offset, length, hash``, and the chunk's ``data``, of rows ``blob, data``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gear, rows, held = _gear(), [], 0
        columns = ["blob", "idx", "offset", "length", "hash", "data"]
        for b in batches:
            for name, data in zip(b["blob"], b["data"], strict=True):
                start = 0
                data = bytes(data or b"")
                for i, end in enumerate(cut_points(data, least, usual, most, gear)):
                    part = data[start:end]
                    rows.append((name, i, start, end - start, hashlib.sha256(part).digest(), part))
                    start = end
                held += len(data)
                if held >= PUT_OUT:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return blobs.select("blob", "data").mapInPandas(run, "blob string, idx long, offset long, length long, hash binary, data binary")


def reconstruct(manifest: DataFrame, store: DataFrame) -> DataFrame:
    """``blob, data, ok`` from a manifest and chunks by hash; ``ok`` if every chunk is there, has its
    length, and hashes to its name."""
    s = store.select(F.col("hash").alias("s_hash"), F.col("data").alias("part")).dropDuplicates(["s_hash"])
    m = manifest.join(s, manifest.hash == s.s_hash, "left")
    good = F.coalesce((F.octet_length("part") == F.col("length")) & (F.unhex(F.sha2("part", 256)) == F.col("hash")), F.lit(False))
    g = m.withColumn("good", good).groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("idx", "part"))).alias("parts"), F.bool_and("good").alias("ok"))
    whole = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["part"])), ""))
    return g.select("blob", F.when(F.col("ok"), whole).alias("data"), "ok")
