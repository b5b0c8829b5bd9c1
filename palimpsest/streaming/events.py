"""The event path with Structured Streaming: windowed counts with late data, exactly-once messages, session state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, folder: str, like: DataFrame, files: int = 4) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder, with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(folder)


def windowed(events: DataFrame, time: str = "ts", kind: str = "event_type", late: str = "2 hours", size: str = "1 hour") -> DataFrame:
    """start, kind, n, total per window of event time; rows later than ``late`` are left out. Works on streams and on tables."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = timed.groupBy(F.window(time, size), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), kind, "n", "total")


def once(events: DataFrame, key: list[str], time: str, late: str = "1 day") -> DataFrame:
    """A stream without repeated keys; the state of a key is dropped after ``late``."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def drain(stream: DataFrame, checkpoint: str, out: str, mode: str = "append") -> None:
    """Write what there is now and stop; a later call goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
