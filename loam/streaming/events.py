"""Streams of events: windowed counts with a watermark, and turn events appended as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and totals per window and event type; works on a stream and on a table."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("at", late) if events.isStreaming else timed
    grouped = timed.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def record(turns: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of turn events to Parquet files; a batch that is tried again replaces itself."""

    def append(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return turns.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
