"""Token counts by offset-mapped attribution.

Each document is encoded once, as a whole. Byte-level tokens carry their bytes, so running sums of
token lengths are the tokens' spans. The spans are interval-joined to the sections of the document
(sorted, disjoint spans; by default its lines, each with its line break), and every token goes to
exactly one section, so the counts of the sections add up to the count of the document.

A token that crosses a section boundary goes, by rule ``first``, to the section that holds its first
byte, or, by rule ``majority``, to the one that holds most of its bytes (the earlier of equals).
"""

from __future__ import annotations

import base64
import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("first", "majority")
OUT = "section long, start_char long, end_char long, n_tokens long, n_crossing long"
#: Rows of sections put out at once.
ROWS = 1 << 16


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level vocabulary: the bytes of its rank file, and its splitting pattern."""

    ranks: bytes
    pattern: str

    @classmethod
    def read(cls, path: str | None = None, pattern: str | None = None) -> Vocabulary:
        """Reads ``path`` on the driver; by default a public byte-level BPE of 50 thousand tokens."""
        if path is None or pattern is None:
            import public_tokenizers

            path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
            pattern = pattern or public_tokenizers.PATTERN
        with open(path, "rb") as f:
            return cls(f.read(), pattern)


def encoder(vocabulary: Vocabulary):
    """A function from text to the byte lengths of its tokens; built once per Python process."""
    cache = sys.modules.setdefault("_shelfmark_encoders", types.ModuleType("_shelfmark_encoders")).__dict__
    key = (hash(vocabulary.ranks), vocabulary.pattern)
    if key not in cache:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.ranks.splitlines())}
        size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        cache[key] = tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={}), size
    encoding, size = cache[key]
    return lambda text: size[np.array(encoding.encode_ordinary(text), dtype=np.int64)]


def line_spans(text: str) -> np.ndarray:
    """Ends of the lines in characters; a line holds its line break. An empty text is one line."""
    ends = [i + 1 for i, c in enumerate(text) if c == "\n"] if "\n" in text else []
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return np.array(ends, dtype=np.int64)


def byte_ends(text: str, ends: np.ndarray) -> np.ndarray:
    """Where these character positions lie in the UTF-8 bytes."""
    if text.isascii():
        return ends
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    starts = np.append(np.flatnonzero((b & 0xC0) != 0x80), len(b))
    return starts[ends]


def attribute(token_sizes: np.ndarray, ends: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Tokens for each section, and how many of them cross a boundary. ``ends``: section ends in bytes."""
    stop = np.cumsum(token_sizes)
    start = stop - token_sizes
    first = np.searchsorted(ends, start, side="right")
    last = np.searchsorted(ends, stop - 1, side="right")
    own = first
    if rule == "majority":
        own = first.copy()
        for i in np.flatnonzero(first != last):
            cuts = np.concatenate(([start[i]], ends[first[i] : last[i]], [stop[i]]))
            own[i] = first[i] + int(np.argmax(np.diff(cuts)))
    n = len(ends)
    return np.bincount(own, minlength=n), np.bincount(own[first != last], minlength=n)


def section_tokens(df: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: Vocabulary | None = None, rule: str = "first") -> DataFrame:
    """One row per section (line) of each row: id, ``section`` (from 0), ``start_char, end_char``,
    ``n_tokens``, ``n_crossing`` (tokens counted here that also reach into a later or earlier section).

    Null texts count as empty; an empty text has one section without tokens. Null and repeated ids
    are carried as they are, repeated rows each give their sections. Whole texts are encoded; special
    tokens' strings are ordinary text. Other columns are ignored; an empty table gives an empty one.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    own = vocabulary or Vocabulary.read()
    shared = df.sparkSession.sparkContext.broadcast((own.ranks, own.pattern))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes_of = encoder(Vocabulary(*shared.value))
        parts: list[tuple] = []
        rows = 0

        def flush() -> pd.DataFrame:
            out = {"id": np.repeat(np.array([p[0] for p in parts], dtype=object), [len(p[1]) for p in parts])}
            for k, name in enumerate(("section", "start_char", "end_char", "n_tokens", "n_crossing"), 1):
                out[name] = np.concatenate([p[k] for p in parts])
            return pd.DataFrame(out)

        for batch in batches:
            for key, value in zip(batch["id"], batch["text"], strict=True):
                value = value or ""
                ends = line_spans(value)
                n, crossing = attribute(sizes_of(value), byte_ends(value, ends), rule)
                parts.append((key, np.arange(len(ends)), np.concatenate(([0], ends[:-1])), ends, n, crossing))
                rows += len(ends)
                if rows >= ROWS:
                    yield flush()
                    parts, rows = [], 0
        if parts:
            yield flush()

    slim = df.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"))
    out = slim.mapInPandas(run, f"id string, {OUT}")
    return out.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "section", "start_char", "end_char", "n_tokens", "n_crossing")
