"""Streams of URLs: the seen-set and the retry timers.

The seen-set never forgets, as in batch: there is no watermark, and its state is kept by RocksDB on
the executors and in the checkpoint. Where a bounded memory of URLs is enough, give a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def unseen_stream(urls: DataFrame, key: str = "url", within: tuple[str, str] | None = None) -> DataFrame:
    """Each key once. ``within``: (event time column, delay) to forget keys after."""
    if within is None:
        return urls.dropDuplicates([key])
    return urls.withWatermark(*within).dropDuplicatesWithinWatermark([key])


def retry_stream(attempts: DataFrame, most: int = 2) -> DataFrame:
    """(authority, failures, outcome): failed look-ups counted by authority, with what follows from the count."""
    counted = attempts.groupBy("authority").agg(F.sum(F.col("failed").cast("int")).alias("failures"), F.max((~F.col("failed")).cast("int")).alias("ok"))
    outcome = F.when(F.col("ok") == 1, "add").when(F.col("failures") <= most, "delay").otherwise("drop")
    return counted.select("authority", "failures", outcome.alias("outcome"))


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what there is and ends; ``sink`` gets each micro-batch. Exactly once if the sink is idempotent by batch number."""
    return df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
