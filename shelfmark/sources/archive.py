"""Binary catalog archives: front-coded entries of packages in Zstandard frames.

An archive is a header, frames, and (from version 2) a table of the frames' lengths at its end. Frames
end where a package ends and decode on their own, so they are dealt to all executors; version 1 is one
frame. Inside, each entry is its properties, a zero byte, by how much the prefix shared with the path
before grew, the rest of the path, and a line feed. A package's entries are followed by the package.
"""

from __future__ import annotations

import json
import math
import struct
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..storage import cut

# Fixed values of the format.
MAGIC, VERSIONS, HEADER = b"NIXI", (1, 2), 12
TABLE_MAGIC = 0x184D2A50
PACKAGE, LONG_STEP, MAX_SHARED = b"p", 0x80, 32767
MAX_FRAMES, MAX_BYTES = 1 << 20, 2 << 30

#: Bytes decompressed at once, entries put out at once, bytes before compression at which a frame ends.
PIECE, ROWS, FRAME = 1 << 20, 1 << 15, 4 << 20
#: Compressed bytes that one task decodes at most, about.
SHARE = 64 << 20
_DECODED = "archive string, frame long, n long, package string, path string, kind string, size long, target string"
_KEYS = ("store_dir", "hash", "name")
_ORIGIN = ("attr", "output", "toplevel", "system")


class BadArchive(ValueError):
    pass


def frames_of(data: bytes | memoryview) -> list[tuple[int, int]]:
    """(offset, length) of the frames of a whole archive; its header and table are validated."""
    size = len(data)
    if size < HEADER or size > MAX_BYTES or bytes(data[:4]) != MAGIC:
        raise BadArchive("not an archive, or too large")
    (version,) = struct.unpack("<Q", data[4:HEADER])
    if version not in VERSIONS:
        raise BadArchive(f"unknown version {version}")
    if version == 1:
        return [(HEADER, size - HEADER)] if size > HEADER else []
    if size < HEADER + 8:
        raise BadArchive("no room for the table of frames")
    (length,) = struct.unpack("<I", data[-4:])
    start = size - length - 8
    if start < HEADER or length < 8 or length % 4:
        raise BadArchive("the table of frames is cut off")
    magic, declared, n, *lengths = struct.unpack(f"<{length // 4 + 1}I", data[start:-4])
    if magic != TABLE_MAGIC or declared != length or n != len(lengths) or n > MAX_FRAMES or HEADER + sum(lengths) != start:
        raise BadArchive("the table of frames does not fit the file")
    out, at = [], HEADER
    for k in lengths:
        out.append((at, k))
        at += k
    return out


def decoded(pieces: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(properties, path) of front-coded entries that come in pieces of any size."""
    buf, at, last, shared = b"", 0, b"", 0
    for piece in pieces:
        buf, at = buf[at:] + piece, 0
        while (zero := buf.find(b"\0", at)) >= 0 and zero + 1 < len(buf):
            step, rest = (zero + 2, zero + 4) if buf[zero + 1] == LONG_STEP else (zero + 1, zero + 2)
            end = buf.find(b"\n", rest)
            if end < 0:
                break
            shared += int.from_bytes(buf[step:rest], "big", signed=True)
            if not 0 <= shared <= len(last):
                raise BadArchive(f"a prefix of {shared} bytes of a path of {len(last)}")
            last = last[:shared] + buf[rest:end]
            yield buf[at:zero], last
            at = end + 1
    if at < len(buf):
        raise BadArchive("the last entry is cut off")


class FrontCoder:
    """Encodes entries of one package after the other."""

    def __init__(self) -> None:
        self.last, self.shared = b"", 0

    def entry(self, properties: bytes, path: bytes) -> bytes:
        same = 0
        for x, y in zip(self.last[:MAX_SHARED], path, strict=False):
            if x != y:
                break
            same += 1
        return self._put(properties, path, same)

    def package(self, value: bytes) -> bytes:
        out = self._put(PACKAGE, value, 0)
        self.last = b""
        return out

    def _put(self, properties: bytes, path: bytes, same: int) -> bytes:
        if b"\0" in properties + path or b"\n" in properties + path:
            raise BadArchive("zero bytes and line feeds cannot be recorded")
        step, self.last, self.shared = same - self.shared, path, same
        coded = step.to_bytes(1, "big", signed=True) if abs(step) < 127 else bytes([LONG_STEP]) + step.to_bytes(2, "big", signed=True)
        return properties + b"\0" + coded + path[same:] + b"\n"


def _inflated(data: bytes) -> Iterator[bytes]:
    import zstandard

    try:
        with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as r:
            while piece := r.read(PIECE):
                yield piece
    except zstandard.ZstdError as e:
        raise BadArchive(str(e)) from e


def frame_rows(data: bytes) -> Iterator[tuple]:
    """``n, package, path, kind, size, target``: entries, then the package they belong to (its JSON, and
    no path). ``n`` counts packages of the frame; those without entries are left out."""
    n, some = 0, False
    for properties, path in decoded(_inflated(data)):
        if properties == PACKAGE:
            if some:
                yield n, path.decode("utf-8", "replace"), None, None, None, None
                n, some = n + 1, False
            continue
        kind, value = properties[-1:].decode("latin-1"), properties[:-1]
        if kind == "s":
            size, target = 0, value.decode("utf-8", "replace")
        elif kind in ("r", "x", "d") and value.isdigit():
            size, target = int(value), None
        else:
            raise BadArchive(f"properties {properties!r}")
        some = True
        yield n, None, path.decode("utf-8", "replace"), kind, size, target
    if some:
        raise BadArchive("entries without a package")


def _batches(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) >= ROWS:
            yield pd.DataFrame(some, columns=columns).astype({"size": "Int64"})
            some = []
    if some:
        yield pd.DataFrame(some, columns=columns).astype({"size": "Int64"})


def read_archives(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``packages`` and ``files`` of an archive, or of all archives of a folder.

    Packages are numbered densely in the order of archives (by path) and of packages in them. Bytes
    that are not UTF-8 become the replacement character. A damaged archive is an error.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                for i, (at, k) in enumerate(frames_of(data)):
                    yield pd.DataFrame({"archive": [name], "frame": [i], "data": [bytes(data[at : at + k])]})

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _DECODED.split(", ")]
        for b in batches:
            for name, i, data in zip(b["archive"], b["frame"], b["data"], strict=True):
                yield from _batches(((name, i, *r) for r in frame_rows(bytes(data))), columns)

    found = spark.read.format("binaryFile").load(path)
    most = found.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), math.ceil(most / SHARE))
    frames = found.select("path", "content").mapInPandas(split, "archive string, frame long, data binary")
    dealt = frames.repartition(parts, "archive", "frame")
    rows = cut(dealt.mapInPandas(decode, _DECODED))
    # One row per frame, then one per archive, is all that the running sums see.
    counts = rows.where(F.col("package").isNotNull()).groupBy("archive", "frame").agg(F.count("*").alias("k"))
    before = Window.partitionBy("archive").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("inside", F.coalesce(F.sum("k").over(before), F.lit(0)))
    whole = counts.groupBy("archive").agg(F.sum("k").alias("k"))
    earlier = Window.orderBy("archive").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("archive", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("outside"))
    starts = counts.join(whole, "archive").select("archive", "frame", (F.col("inside") + F.col("outside")).alias("start"))
    rows = rows.join(starts, ["archive", "frame"]).withColumn("pkg_id", (F.col("start") + F.col("n")).cast("long"))
    shape = "store_dir string, hash string, name string, origin struct<attr: string, output: string, toplevel: boolean, system: string>"
    p = rows.where(F.col("package").isNotNull()).select("pkg_id", F.from_json("package", shape, {"mode": "FAILFAST"}).alias("p"))
    packages = p.select("pkg_id", *[f"p.origin.{k}" for k in _ORIGIN], *[f"p.{k}" for k in _KEYS])
    return packages, rows.where(F.col("path").isNotNull()).select("pkg_id", "path", "kind", "size", "target")


def archive_frames(packages: DataFrame, files: DataFrame, level: int = 9, frame_bytes: int = FRAME) -> DataFrame:
    """``first, data``: compressed frames with the smallest package number in each.

    Files are put in ranges of packages and sorted by package and path, so a frame holds whole packages.
    Packages without entries, and entries that cannot be recorded, are left out; a link's null target
    becomes an empty one, a null size 0.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        coder, now, footer, first, size = FrontCoder(), None, b"", 0, 0
        packer, out = zstandard.ZstdCompressor(level=level).compressobj(), []
        for b in batches:
            for r in b.itertuples(index=False):
                if now is not None and r.pkg_id != now:
                    end = coder.package(footer)
                    size += len(end)
                    out.append(packer.compress(end))
                    if size >= frame_bytes:
                        yield pd.DataFrame({"first": [first], "data": [b"".join(out) + packer.flush()]})
                        packer, out, size = zstandard.ZstdCompressor(level=level).compressobj(), [], 0
                if r.pkg_id != now:
                    first = r.pkg_id if size == 0 else first
                    now = r.pkg_id
                    footer = r.package.encode()
                value = (r.target or "") if r.kind == "s" else str(int(r.size))
                line = coder.entry(f"{value}{r.kind}".encode(), r.path.encode())
                size += len(line)
                out.append(packer.compress(line))
        if now is not None:
            yield pd.DataFrame({"first": [first], "data": [b"".join([*out, packer.compress(coder.package(footer))]) + packer.flush()]})

    # Null fields stay in the JSON: readers of the format expect every key.
    origin = F.struct(*_ORIGIN)
    value = F.to_json(F.struct(*_KEYS, origin.alias("origin")), {"ignoreNullFields": "false"})
    named = packages.select("pkg_id", value.alias("package"))
    kept = files.where(fn.encodable(F.col("path")) & fn.encodable(F.col("target")))
    joined = kept.select("pkg_id", "path", "kind", F.coalesce("size", F.lit(0)).alias("size"), "target").join(named, "pkg_id")
    return joined.repartitionByRange("pkg_id").sortWithinPartitions("pkg_id", "path").mapInPandas(encode, "first long, data binary")


def write_archive(packages: DataFrame, files: DataFrame, path: str, level: int = 9, frame_bytes: int = FRAME) -> int:
    """Writes one archive of version 2 through Hadoop's file system; returns its number of frames.

    Executors encode and compress; the driver only appends frames in order, one partition's at a time,
    beside the place, then renames. The format ends at 2 GiB: more is an error.
    """
    spark = files.sparkSession
    frames = cut(archive_frames(packages, files, level, frame_bytes)).orderBy("first")
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    tmp = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    lengths, out = [], fs.create(tmp, True)
    try:
        out.write(bytearray(MAGIC + struct.pack("<Q", VERSIONS[-1])))
        for r in frames.toLocalIterator():
            out.write(bytearray(r["data"]))
            lengths.append(len(r["data"]))
            if len(lengths) > MAX_FRAMES or out.getPos() + 4 * len(lengths) + 16 > MAX_BYTES:
                raise BadArchive("too large for one archive: write ranges of packages to several")
        k = 4 * len(lengths) + 8
        out.write(bytearray(struct.pack(f"<{len(lengths) + 4}I", TABLE_MAGIC, k, len(lengths), *lengths, k)))
    except BaseException:
        out.close()
        fs.delete(tmp, False)
        raise
    out.close()
    if fs.exists(to):
        fs.delete(to, False)
    fs.rename(tmp, to)
    return len(lengths)


def package_json(package: dict) -> str:
    """A package's record as archives hold it."""
    return json.dumps({k: package[k] for k in _KEYS} | {"origin": {k: package.get(k) for k in _ORIGIN}}, separators=(",", ":"), ensure_ascii=False)
