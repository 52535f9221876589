"""Refreshing a catalog from a stream of evaluation records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..catalog import Catalog
from ..sources import evaluation


def _started(lines: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None) -> StreamingQuery:
    out = lines.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    out = out.trigger(availableNow=True) if seconds is None else out.trigger(processingTime=f"{seconds} seconds")
    return out.start()


def refresh(spark: SparkSession, source: str, target: str, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Appends the outputs of new NDJSON files below ``source`` to the table at ``target``.

    Each batch is written under its number, so a batch that runs again after a failure replaces what
    it wrote. Without ``seconds`` what is there is read and the query ends.
    """

    def append(batch: DataFrame, number: int) -> None:
        evaluation.outputs(evaluation.records(batch)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return _started(spark.readStream.text(source), append, checkpoint, seconds)


def republish(spark: SparkSession, source: str, path: str, checkpoint: str, rebuild: Callable[[DataFrame], Catalog], seconds: int | None = None) -> StreamingQuery:
    """Publishes a new version of the catalog at ``path`` whenever there are new files below ``source``.

    A batch appends its outputs to the table ``outputs`` below ``path``, and ``rebuild`` makes a catalog
    of all of them, which is published by its pointer in one step: readers that opened a version keep
    it. Files that come while a build runs wait and make one batch together, however many they are.
    """

    def publish(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        evaluation.outputs(evaluation.records(batch)).write.mode("overwrite").parquet(f"{path}/outputs/batch={number}")
        rebuild(spark.read.parquet(f"{path}/outputs").drop("batch"))

    return _started(spark.readStream.text(source), publish, checkpoint, seconds)


def changed(before: str | None, now: str | None) -> bool:
    """Whether a remote token (ETag, date) differs; like is compared with like."""
    return now is None or before != now
