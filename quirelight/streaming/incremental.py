"""Incremental runs: pages not done yet, resumable batches, and windowed counts of an event stream.

The windowed counts are an extension: there is no event time in the operators above.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending_pages(pages: DataFrame, done: DataFrame) -> DataFrame:
    """(doc_id, page) not yet done: what a cancelled run goes on with."""
    return pages.select("doc_id", "page").distinct().join(done.select("doc_id", "page"), ["doc_id", "page"], "left_anti")


def resumable(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Start a stream that runs ``work`` on each batch and writes it once under its batch number.

    A batch that is run again after a failure overwrites its own folder.
    """

    def one(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) by event time; the same plan for a table and for a stream.

    On a stream, events later than ``late`` behind the newest are dropped with their
    window's state; on a table all count.
    """
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")
