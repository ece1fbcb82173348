"""Event-time windows, the same for tables and streams, and idempotent streaming ingest."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    """Streams get a watermark, for which the time must be a TIMESTAMP."""
    if not events.isStreaming:
        return events
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late or "10 minutes")


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Count and sum (in cents) by tumbling or sliding window and kind."""
    w = F.window("ts", size, slide or size)
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents")
    return _timed(events, late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), cents).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """A user's runs of events without a pause of ``gap`` or more."""
    return _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """Each key once; a stream forgets keys behind the watermark."""
    timed = _timed(events, late)
    return timed.dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else timed.dropDuplicates(list(keys))


def ingest_new(events: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Appends to a Parquet table the rows whose key it does not hold; a rerun, or a batch tried again, adds nothing.

    Each batch has a folder of its own, overwritten when it is tried again, so no batch is written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        target = os.path.join(path, f"batch={number}")
        fresh = batch.dropDuplicates([key])
        try:
            held = spark.read.parquet(path).where(F.col("batch") != number).select(key)
        except Exception as error:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            held = None
        if held is not None:
            fresh = fresh.join(held, key, "left_anti")
        fresh.write.mode("overwrite").parquet(target)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
