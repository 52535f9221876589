"""Fuzzy scores: every character of the needle in order, closer and better placed hits higher."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HIT, RUN, START, BOUNDARY, WHOLE, GAP = 16, 8, 8, 6, 12, 1


def subsequence(col: Column, needle: str, case_sensitive: bool = False) -> Column:
    """Whether the needle's characters occur in order: a native filter before any scoring."""
    body = ".*".join(f"\\Q{c}\\E" if c != "\\" else r"\\" for c in needle)
    return F.coalesce(col.rlike(("(?s)" if case_sensitive else "(?sui)") + body), F.lit(False))


def score_of(needle: str, text: str | None, case_sensitive: bool = False) -> int:
    """Best affine score over all placements; 0 if the needle does not occur in order."""
    if text is None:
        return 0
    raw = text
    if not case_sensitive:
        needle, text = needle.lower(), text.lower()
    if not needle:
        return 0
    n = len(text)
    edge = [i == 0 or not raw[min(i, len(raw)) - 1].isalnum() for i in range(n)]
    low = -(10**9)
    last = [low] * n  # best score with the current character placed at i
    for k, c in enumerate(needle):
        now, best = [low] * n, 0 if k == 0 else low
        for i in range(n):
            if k and i:
                best = max(best - GAP, last[i - 1])
            if text[i] == c:
                bonus = HIT + (START if i == 0 else BOUNDARY if edge[i] else 0)
                run = last[i - 1] + RUN if k and i else low
                now[i] = bonus + max(best if k else 0, run)
        last = now
    top = max(last, default=low)
    if top < 0:
        return 0
    return top + (WHOLE if needle == text else 0)


def scores_of(needle: str, texts: list[str | None], case_sensitive: bool = False) -> np.ndarray:
    """``score_of`` for a batch: one pass over all texts for each character of the needle."""
    known = [t or "" for t in texts]
    shown = known if case_sensitive else [t.lower() for t in known]
    needle = needle if case_sensitive else needle.lower()
    width = max(map(len, shown), default=0)
    if not needle or not width:
        return np.zeros(len(texts), dtype=np.int32)
    chars = np.array([t.ljust(width, "\0") for t in shown], dtype=f"U{width}").view(np.int32).reshape(len(texts), width)
    raw = np.array([t[:width].ljust(width, "\0") for t in known], dtype=f"U{width}").view("U1").reshape(len(texts), width)
    at, low = np.arange(width), -(10**9)
    bonus = np.full(chars.shape, HIT, dtype=np.int64)
    bonus[:, 1:] += np.where(np.char.isalnum(raw[:, :-1]), 0, BOUNDARY)
    bonus[:, 0] += START
    last = None
    for c in needle:
        hit = chars == ord(c)
        if last is None:
            last = np.where(hit, bonus, low)
            continue
        # The best place before each one: a gap costs the same wherever it is, so a running maximum does.
        before = np.full(chars.shape, low, dtype=np.int64)
        before[:, 1:] = np.maximum.accumulate(last + GAP * at, axis=1)[:, :-1] - GAP * at[:-1]
        before[:, 1:] = np.maximum(before[:, 1:], last[:, :-1] + RUN)
        last = np.where(hit, bonus + before, low)
    top = last.max(axis=1)
    whole = np.array([t == needle for t in shown])
    return np.where(top < 0, 0, top + WHOLE * whole).astype(np.int32)


def scorer(needle: str, case_sensitive: bool = False):
    @F.pandas_udf("int")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(scores_of(needle, batch.tolist(), case_sensitive), dtype="int32")

    return score
