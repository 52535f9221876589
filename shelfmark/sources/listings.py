"""File trees in JSON, reference lists, compressed payloads, and mirrors of a remote store."""

from __future__ import annotations

import json
import lzma
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as fn

MAX_BYTES, MAX_DEPTH = 32 << 20, 64
HASH_LENGTH = 32
#: Entries put out at once.
ROWS = 1 << 15


class BadTree(ValueError):
    pass


def flatten(document: str | bytes) -> list[tuple[str, str, int, str | None]]:
    """(path, kind, size, target) of each node of a file tree, the root's path empty. One bad node
    rejects the document. A directory's size is its number of children, a link's is 0."""
    if len(document if isinstance(document, bytes) else document.encode()) > MAX_BYTES:
        raise BadTree("the document is too large")
    try:
        root = json.loads(document)
    except (ValueError, RecursionError) as e:
        raise BadTree(str(e)) from e
    if isinstance(root, dict) and "root" in root:
        root = root["root"]
    out, stack = [], [("", root, 0)]
    while stack:
        path, node, depth = stack.pop()
        if depth > MAX_DEPTH:
            raise BadTree("the tree is too deep")
        kind = node.get("type") if isinstance(node, dict) else None
        if kind == "regular":
            out.append((path, "x" if node.get("executable") else "r", int(node.get("size") or 0), None))
        elif kind == "symlink":
            if not isinstance(node.get("target"), str):
                raise BadTree("a link without target")
            out.append((path, "s", 0, node["target"]))
        elif kind == "directory":
            entries = node.get("entries") or {}
            out.append((path, "d", len(entries), None))
            for name, child in entries.items():
                if "/" in name or "\\" in name or name in (".", "..", ""):
                    raise BadTree(f"not a file name: {name!r}")
                stack.append((f"{path}/{name}", child, depth + 1))
        else:
            raise BadTree(f"unknown node type {kind!r}")
    return sorted(out)


def file_rows(trees: DataFrame, key: str = "hash", prefix: str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Entries of documents ``key, tree``. Rejected documents give none. Paths and link targets that
    cannot be recorded are dropped; ``prefix`` keeps, ``exclude`` drops what starts so."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, rows = ["k", "path", "kind", "size", "target"], []
        for b in batches:
            for k, t in zip(b["k"], b["t"], strict=True):
                try:
                    rows += [(k, *r) for r in flatten(t)] if t is not None else []
                except BadTree:
                    continue
                if len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    out = trees.select(F.col(key).alias("k"), F.col("tree").alias("t")).mapInPandas(run, "k string, path string, kind string, size long, target string")
    out = out.where(fn.encodable(F.col("path")) & fn.encodable(F.col("target")))
    if prefix:
        out = out.where(F.col("path").startswith(prefix))
    for p in exclude:
        out = out.where(~F.col("path").startswith(p))
    return out.withColumnRenamed("k", key)


def references(narinfo: DataFrame, key: str = "hash") -> DataFrame:
    """``key, url, ok`` and the references as ``ord, dst_hash, dst_name``, one row each, of texts in
    ``value``. A bad reference fails its record: ``ok`` is false and it has no references."""
    line = F.regexp_extract("value", r"(?m)^References:[ \t]*(.*)$", 1)
    tokens = F.filter(F.split(F.trim(line), r"\s+"), lambda t: t != "")
    parsed = F.transform(tokens, lambda t: F.struct(F.substring_index(t, "-", 1).alias("dst_hash"), F.when(F.instr(t, "-") > 0, F.substring(t, F.instr(t, "-") + 1, F.length(t))).otherwise("").alias("dst_name")))
    good = F.forall(parsed, lambda p: (F.length(p["dst_hash"]) == HASH_LENGTH) & (p["dst_name"] != ""))
    url = F.regexp_extract("value", r"(?m)^URL:[ \t]*(\S+)", 1)
    out = narinfo.select(key, F.when(url != "", url).alias("url"), good.alias("ok"), F.when(good, parsed).alias("refs"))
    return out.select(key, "url", "ok", F.posexplode_outer("refs").alias("ord", "ref")).select(key, "url", "ok", "ord", "ref.dst_hash", "ref.dst_name")


def decompressed(data: bytes, most: int = MAX_BYTES) -> bytes:
    """Zstandard, xz or plain by their magic; more than ``most`` bytes is an error."""
    if data[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        with zstandard.ZstdDecompressor().stream_reader(data) as r:
            out = r.read(most + 1)
    elif data[:6] == b"\xfd7zXZ\x00":
        out = lzma.LZMADecompressor().decompress(data, max_length=most + 1)
    else:
        out = data
    if len(out) > most:
        raise ValueError("the payload is too large")
    return out


def read_payloads(spark: SparkSession, path: str, most: int = MAX_BYTES) -> DataFrame:
    """``path, tree, error`` of the files below a folder, decompressed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, data in zip(b["path"], b["content"], strict=True):
                try:
                    rows.append((p, decompressed(bytes(data), most).decode("utf-8", "replace"), None))
                except Exception as e:
                    rows.append((p, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "tree", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, tree string, error string")


def fetched(spark: SparkSession, path: str, keys: DataFrame, key: str = "key", suffix: str = "") -> DataFrame:
    """``key, status, body`` for each key, from a mirror folder in any store that Spark reads: 200 with the
    file's bytes, or 404 where there is none. Each distinct key is looked up once."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
    name = F.url_decode(F.substring_index("path", "/", -1))
    files = files.select(F.substring(name, F.lit(1), F.length(name) - len(suffix)).alias("name"), "content")
    out = keys.select(F.col(key).alias("key")).distinct().join(files, F.col("key") == F.col("name"), "left")
    return out.select("key", F.when(F.col("content").isNull(), 404).otherwise(200).alias("status"), F.col("content").alias("body"))


class MirrorSource(DataSource):
    """Reads keys from a mirror folder that every executor mounts: ``key, status, body``, with 404 where
    there is no file, and retries with growing pauses. ``fetched`` reads any store instead.

    Options: ``path``, ``keys`` (separated by line feeds), ``suffix``, ``partitions``, ``retries``.
    """

    @classmethod
    def name(cls) -> str:
        return "mirror"

    def schema(self) -> str:
        return "key string, status int, body binary"

    def reader(self, schema) -> DataSourceReader:
        return _MirrorReader(dict(self.options))


class _MirrorReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.keys = [k for k in options.get("keys", "").split("\n") if k]
        self.n, self.retries = int(options.get("partitions", "8")), int(options.get("retries", "4"))

    def partitions(self):
        return [InputPartition(self.keys[i :: self.n]) for i in range(min(self.n, max(1, len(self.keys))))]

    def read(self, partition):
        import os
        import time

        for key in partition.value:
            for attempt in range(self.retries + 1):
                try:
                    with open(os.path.join(self.path, key + self.suffix), "rb") as f:
                        yield key, 200, f.read()
                    break
                except FileNotFoundError:
                    yield key, 404, None
                    break
                except OSError:
                    if attempt == self.retries:
                        yield key, 503, None
                    else:
                        time.sleep(min(16, 2**attempt) * 0.01)
