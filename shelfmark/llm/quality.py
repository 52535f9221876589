"""Quality classifier: gradient-boosted trees over document statistics.

Statistics are taken from whole texts; language, source, id and labels are no inputs. The trees are
fitted on the driver on at most ``SAMPLE`` labelled rows that are not held out (a documented bound:
the rows with the smallest hash of their id), and scoring traverses their flat arrays in numpy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit
from .common import free_name

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE = 20_000
#: Rows scored at once.
ROWS = 2048
SYMBOLS = b"!#$%&*|\"=@.,;:?-()"


def statistics(text: str | None) -> list[float]:
    """The inputs of the classifier for one text; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n = max(1, len(raw))
    words, lines = raw.split(), raw.split(b"\n")
    w = max(1, len(words))
    kinds = Counter(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    twice = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))  # noqa: B905
    line_kinds = Counter(lines)
    top = [k for _, k in kinds.most_common(3)] + [0, 0, 0]
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        float(size.mean()) if len(size) else 0.0,
        float(size.std()) if len(size) else 0.0,
        float(size.max()) if len(size) else 0.0,
        hist[65:91].sum() / n,
        hist[97:123].sum() / n,
        hist[48:58].sum() / n,
        hist[128:].sum() / n,
        (hist[9:14].sum() + hist[32]) / n,
        len(lines) / w,
        len(kinds) / w,
        len(kinds) / w**0.7,
        top[0] / w,
        (top[0] + top[1] + top[2]) / w,
        twice / w,
        pairs / w,
        len(line_kinds) / len(lines),
        max(line_kinds.values()) / len(lines),
        w / len(lines),
        sum(1 for x in kinds if x.isupper()) / max(1, len(kinds)),
        *(hist[c] / w for c in SYMBOLS),
    ]


WIDTH = len(statistics(None))


def matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, WIDTH)


def held_out(id_col: Column) -> Column:
    """Rows that are kept from training: crc32 of the id as text, modulo 5, is 0. Null ids are not."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Trees:
    """Fits on labelled rows that are not held out. Rows without id or label, and labels without a
    document, are ignored; of several labels for an id the least counts. Without labels, or with one
    class, every text gets the same score."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).alias("y")).where("id is not null and y is not null")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.min("y").alias("y"))
    some = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(some), "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"].astype(str), "y": b["y"].astype(float), "x": list(matrix(b["text"]))})

    # One row per labelled row: the sample bounds what comes to the driver.
    found = rows.mapInPandas(run, "id string, y double, x array<double>").orderBy(F.xxhash64("id"), "id", "x").limit(sample).toPandas()
    x = np.array(found["x"].tolist(), dtype=np.float64).reshape(-1, WIDTH)
    return fit(x, (found["y"].to_numpy() > 0).astype(np.float64))


def with_scores(df: DataFrame, model: Trees, text: str = "text", out: str = "score") -> DataFrame:
    """Adds ``out``: the probability of label 1, for null and empty texts too."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            parts = [model.probability(matrix(b.iloc[i : i + ROWS])) for i in range(0, len(b), ROWS)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return df.withColumn(out, score(F.col(text)))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out, score, predicted`` (1 if the score reaches the threshold).

    Null and empty texts are scored like others; repeated rows each give a row; an empty table gives
    an empty one. Other columns are ignored.
    """
    model = train(docs, labels, label, id_col, text)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    s = with_scores(slim, model)
    return s.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with the columns of ``docs``."""
    score = free_name(docs, "score")
    s = with_scores(docs, train(docs, labels, label, id_col, text), text, score)
    return s.where(F.col(score) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
