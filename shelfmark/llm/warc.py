"""WARC archives in Zstandard frames: one frame per record, the dictionary in the leading frame.

An archive starts with a skippable frame that holds the dictionary; each record is a frame of its
own. Archives are written by Spark's text writer, so they land in any file system that Spark can
reach and commit like any other output; the line separator is an empty skippable frame, which
readers of the format pass over. One archive is written per partition, so the size of a partition
bounds it. Records are ``response`` records with an HTTP head and the payload, or ``revisit`` records
(identical payload digest) that keep the head only and refer to the response.

The reader takes archives as binary files, checks the leading frame, decodes frame by frame and
validates version line, required headers, block and payload lengths and digests.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpoint, shared_folder

#: Payloads from this size are written once and revisited.
LEAST = 100
#: Pages that the dictionary is trained on, at most, and the characters of each.
SAMPLE, SAMPLE_CHARS, DICT_BYTES = 400, 8192, 32768
#: Bytes of an archive that the decoder is given at once.
PIECE = 1 << 12
# Fixed values of the formats.
DICT_FRAME = b"\x5d\x2a\x4d\x18"
SKIP_FRAME = b"\x50\x2a\x4d\x18"
SEPARATOR = (SKIP_FRAME + b"\x00\x00\x00\x00").decode("ascii")
ZSTD_FRAME = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
READ = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


class BadArchive(ValueError):
    """An archive or record that breaks the format."""


def _plain(value: str) -> str:
    """A header value on one line: control and non-ASCII characters are percent-encoded."""
    return quote(value, safe="!#$%&'()*+,/:;=?@[]~-._ \"<>\\^`{|}")


def _id(page: str) -> str:
    return f"<urn:x-page:{quote(page, safe='')}>"


def record(page: str, url: str | None, payload: bytes, digest: str, first: str | None) -> bytes:
    """One WARC record; a revisit if ``first`` names the page whose response holds the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if first is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {_id(page)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_plain(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id(first)}"] if first is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise BadArchive(f"a header line without a colon: {line[:60]!r}")
        out[name.decode("utf-8").strip().lower()] = value.decode("utf-8").strip()
    return out


def _page_of(record_id: str) -> str:
    from urllib.parse import unquote

    if not record_id.startswith("<urn:x-page:") or not record_id.endswith(">"):
        raise BadArchive(f"not a record id of this archive: {record_id[:60]}")
    return unquote(record_id[len("<urn:x-page:") : -1])


def parse_record(raw: bytes) -> dict:
    """Reads and validates one record."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap or not head.startswith(VERSION):
        raise BadArchive("no version line or no end of headers")
    h = _headers(head.split(b"\r\n")[1:])
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise BadArchive(f"the header {name} is missing")
    size = int(h["content-length"])
    block, tail = rest[:size], rest[size:]
    if len(block) != size or tail != b"\r\n\r\n":
        raise BadArchive(f"the block has not the {size} bytes of its header")
    if "warc-block-digest" in h and h["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise BadArchive("the block digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        raise BadArchive("no HTTP head")
    length = int(_headers(http.split(b"\r\n")[1:]).get("content-length", len(payload)))
    digest = h.get("warc-payload-digest", "").removeprefix("sha256:")
    kind = h["warc-type"]
    if kind == "response":
        if length != len(payload):
            raise BadArchive(f"the payload has {len(payload)} bytes, its head says {length}")
        if digest != hashlib.sha256(payload).hexdigest():
            raise BadArchive("the payload digest differs")
    elif kind == "revisit":
        if payload or "warc-refers-to" not in h:
            raise BadArchive("a revisit has a payload or refers to nothing")
    else:
        raise BadArchive(f"unknown record type {kind}")
    return {
        "record_type": kind,
        "record_id": _page_of(h["warc-record-id"]),
        "target_uri": h.get("warc-target-uri"),
        "refers_to": _page_of(h["warc-refers-to"]) if kind == "revisit" else None,
        "payload_digest": digest,
        "payload_bytes": length,
        "payload": payload if kind == "response" else None,
    }


def frames(data: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, the dictionary taken from its leading frame if there is one."""
    import zstandard

    at, dictionary, view = 0, None, memoryview(data)
    if data[:4] == DICT_FRAME:
        size = int.from_bytes(data[4:8], "little")
        if len(data) < 8 + size:
            raise BadArchive("the dictionary frame is cut off")
        body = data[8 : 8 + size]
        if body[:4] == ZSTD_FRAME:
            body = zstandard.ZstdDecompressor().decompress(body)
        dictionary, at = zstandard.ZstdCompressionDict(body), 8 + size
    reader = zstandard.ZstdDecompressor(**({"dict_data": dictionary} if dictionary else {}))
    while at < len(data):
        if 0x50 <= data[at] <= 0x5F and data[at + 1 : at + 4] == SKIP_FRAME[1:]:
            if at + 8 > len(data):
                raise BadArchive("a skippable frame is cut off")
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            continue
        if data[at : at + 4] != ZSTD_FRAME:
            if data[at:] == b"\n":
                return
            raise BadArchive(f"no frame at byte {at}")
        d, out, start = reader.decompressobj(), [], at
        # Fed in pieces: what a frame leaves of its last piece is the only part copied.
        while not d.eof:
            piece = view[at : at + PIECE]
            if not len(piece):
                raise BadArchive("the last frame is cut off")
            try:
                out.append(d.decompress(piece))
            except zstandard.ZstdError as e:
                raise BadArchive(f"the frame at byte {start} cannot be decoded: {e}") from e
            at += len(piece)
        at -= len(d.unused_data)
        yield b"".join(out)


def train_dictionary(pages: DataFrame, html: str = "html") -> bytes:
    """A dictionary from a bounded sample of pages; it changes the size of archives, nothing else."""
    import zstandard

    some = pages.where(F.length(html) > 0).select(F.substring(F.col(html), 1, SAMPLE_CHARS).alias("t")).limit(SAMPLE).collect()
    samples = [r["t"].encode("utf-8", "surrogatepass") for r in some]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples
        return b""


def _with_decisions(pages: DataFrame, id_col: str, url: str, html: str, least: int) -> DataFrame:
    """``page, url, payload, digest, first``: ``first`` is the page that a revisit refers to."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("key", F.concat_ws(":", "digest", F.col("page").cast("string")))
    big = rows.where(F.octet_length("payload") >= least).select("page", "digest", "key")
    each = big.groupBy("key").agg(F.min("page").alias("page"), F.min("digest").alias("digest"), F.count("*").alias("n"))
    # Both are written out, so that the join's sides are dealt anew and a hot digest's part can be split.
    each = checkpoint(each)
    low = each.groupBy("digest").agg(F.min(F.struct(F.col("page").isNull().alias("none"), "page")).alias("low"), F.sum("n").alias("all"))
    low = low.where(F.col("all") > 1).select("digest", F.col("low.page").alias("first"))
    same = each.select("key", "digest").join(checkpoint(low), "digest").select(F.col("key").alias("d_key"), "first")
    # Only pages with equals are joined back, by page and digest: no key of that join is hot.
    out = rows.join(same, rows.key == same.d_key, "left")
    nth = F.row_number().over(W.partitionBy("key").orderBy("url"))
    lead = F.col("page").eqNullSafe(F.col("first")) & (nth == 1)
    none = F.col("d_key").isNull() | lead
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return out.select(name(F.col("page")).alias("page"), "url", "payload", "digest", F.when(~none, name(F.col("first"))).alias("first"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, level: int = 3) -> None:
    """Writes one record per row of ``pages`` to archives below ``path`` (``part-*.txt``, zstd frames).

    Payloads are the html in UTF-8, null as empty. Of equal payloads of at least ``least`` bytes the
    row with the smallest id (null ids last; of repeated rows one) is a response and others revisit
    it. An empty table writes no record. Columns other than id, url and html are not archived.
    """
    dictionary = train_dictionary(pages, html)
    lead = DICT_FRAME + len(dictionary).to_bytes(4, "little") + dictionary if dictionary else b""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        pack = zstandard.ZstdCompressor(level=level, write_checksum=True, **options)
        started = not lead
        for b in batches:
            out = []
            if not started and len(b):
                out.append(lead)
                started = True
            for row in b.itertuples(index=False):
                out.append(pack.compress(record(row.page, row.url, bytes(row.payload), row.digest, row.first)))
            yield pd.DataFrame({"frame": pd.Series(out, dtype=object)})

    packed = _with_decisions(pages, id_col, url, html, least).mapInPandas(run, "frame binary")
    # The cast only names the bytes a string: they are written as they are.
    packed.select(F.col("frame").cast("string").alias("value")).write.mode("overwrite").option("lineSep", SEPARATOR).text(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record of the archives below ``path``, in the columns of ``READ``.

    Any break of the format fails the job with ``BadArchive``. ``payload`` false leaves payloads null
    (they are decoded and checked all the same).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                rows, size = [], 0
                for raw in frames(bytes(data)):
                    row = parse_record(raw)
                    size += len(raw) if payload else 0
                    rows.append(row if payload else row | {"payload": None})
                    if size > 1 << 24 or len(rows) >= 4096:
                        yield pd.DataFrame(rows)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInPandas(run, READ)


def round_trip(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, path: str | None = None) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back: one row per record with
    id, ``payload_bytes, payload_digest, record_type, refers_to``."""
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, id_col, url, html, least)
    kind = pages.schema[id_col].dataType
    back = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    r = read_archives(spark, path, payload=False)
    return r.select(back("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", back("refers_to").alias("refers_to"))
