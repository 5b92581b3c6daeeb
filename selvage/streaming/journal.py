"""The journal as a stream: duplicates dropped by id within the watermark, counts by hour.

An extension: the batch functions are the same code, so a stream that has caught up equals the batch result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LATE = "1 day"


def read(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Files appended to a folder (Parquet), as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once(events: DataFrame, late: str = LATE) -> DataFrame:
    """Each event id once; state older than `late` is dropped. On a batch, plain distinct ids."""
    if not events.isStreaming:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def hourly(events: DataFrame, late: str = LATE) -> DataFrame:
    """window_start, kind, n."""
    rows = once(events, late)
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "kind", "n")


def start(counts: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Runs until the input at hand is consumed, into a table in memory."""
    return counts.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
