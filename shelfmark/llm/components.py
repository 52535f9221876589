"""Connected components by alternating large-star and small-star steps, as DataFrame joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Edges (16 bytes each) up to which one task solves what is left; more go through star steps.
SMALL = 100_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Labels each node of an edge list with the smallest node it reaches.

    ``edges`` holds two integer columns; direction, repeats, self-loops and nulls do not matter
    (edges with a null end are ignored). Returns ``node, comp`` for every node that has an edge to
    another node; an empty edge list gives an empty table. A step only takes minima per node
    (combined before the shuffle) and joins them back, so a node with very many neighbours is
    never gathered in one place: minima are written out first, so both sides of the join are dealt
    anew and the adaptive engine can split a node's part (a join on top of an aggregate it cannot).
    The lineage is cut in the shared checkpoint folder after each step.

    A step has a dozen tasks for each shuffle partition, and all weigh on the driver. So none is made
    once all nodes are in stars, or once ``SMALL`` edges or fewer are left, which one task solves.
    """
    e = (
        edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
        .where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    e = checkpoint(e)
    while e.count() > SMALL:
        ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        near = e.select(ends.alias("e")).groupBy("e.a").agg(F.min("e.b").alias("lo"), F.max("e.b").alias("hi"))
        near = checkpoint(near)
        if near.where((F.col("lo") < F.col("a")) & (F.col("lo") < F.col("hi"))).isEmpty():
            # Each node has larger neighbours only, or a single one, which is the centre of its star.
            return near.select(F.col("a").alias("node"), F.least("a", "lo").alias("comp"))
        least = near.select(F.col("a").alias("b"), F.least("a", "lo").alias("m"))
        large = checkpoint(e.join(least, "b").select("a", F.col("m").alias("b")))
        root = checkpoint(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(root, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = checkpoint(small.distinct())
    return _solved(e)


def _solved(e: DataFrame) -> DataFrame:
    """``node, comp`` of a short list of edges, by union-find in one task."""
    kind = e.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[int, int] = {}

        def root(n: int) -> int:
            while (p := up.setdefault(n, n)) != n:
                up[n] = up[p]
                n = p
            return n

        for batch in batches:
            for x, y in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
                x, y = root(x), root(y)
                up[max(x, y)] = min(x, y)
        yield pd.DataFrame({"node": list(up), "comp": [root(n) for n in up]}, dtype="int64")

    return checkpoint(e.coalesce(1).mapInPandas(run, f"node {kind}, comp {kind}"))
