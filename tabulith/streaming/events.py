"""The pipeline's event log as a stream: routing by step, counts with late data, record and replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_log(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """UD4: a stored log as a stream, a few files a batch, in the order in which they were written."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(path)


def route(events: DataFrame, pattern: str) -> DataFrame:
    """UD3: the events whose step matches a regular expression."""
    return events.where(F.col("event_type").rlike(pattern))


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events by step and window of event time; those later than ``late`` after their window are dropped from the state."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, then stop; a later call goes on where this one ended."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def observed(rows: DataFrame, name: str, step: str) -> DataFrame:
    """UD3: counts that a query listener gets when the rows pass; the rows are unchanged."""
    return rows.observe(name, F.lit(step).alias("step"), F.count(F.lit(1)).alias("rows"))
