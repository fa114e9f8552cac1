"""An addition of this library: panels kept fresh from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str, schema: str = EVENTS, files: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def daily(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Bars by user and day; state of a day is dropped once the watermark has passed it."""
    at = F.col("ts").cast("timestamp")
    e = events.withColumn("ts", at).withWatermark("ts", lateness)
    o = F.struct("ts", "event_id")
    g = e.groupBy(F.window("ts", "1 day").alias("w"), F.col("user_id").cast("string").alias("symbol"))
    out = g.agg(F.min_by("value", o).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", o).alias("close"), F.count("value").cast("double").alias("volume"), F.sum("value").alias("amount"))
    return out.select("symbol", F.col("w.start").cast("date").alias("date"), "open", "high", "low", "close", "volume", "amount")


def write(bars: DataFrame, path: str, checkpoint: str):
    """Finished days appended as Parquet, exactly once by the checkpoint."""
    return bars.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
