"""Queries of the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.plans.sources import _folder
from tabulith.registry import register, table
from tabulith.streaming import events as s


@register("ud3_event_route", "SELECT event_id, event_type FROM events WHERE regexp_matches(event_type, '^(click|view)$')")
def ud3_event_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD3: an observer gets the events that its pattern matches."""
    return s.route(table(spark, sf_dir, "events"), "^(click|view)$").select("event_id", "event_type")


@register("ud4_record_replay", "SELECT event_id, event_type FROM events WHERE event_type = 'error'")
def ud4_record_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD3, UD4: a recorded log replayed as a stream through a route into a table."""
    base = _folder(spark)
    table(spark, sf_dir, "events").write.mode("overwrite").parquet(f"{base}/log")
    s.run_once(s.route(s.read_log(spark, f"{base}/log", 4), "error").select("event_id", "event_type"), f"{base}/out", f"{base}/state")
    return spark.read.schema("event_id long, event_type string").parquet(f"{base}/out")


@register("st_windowed_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def st_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by day of event time (the batch form; the stream gives the same rows once a window closes)."""
    rows = table(spark, sf_dir, "events")
    counted = rows.groupBy(F.window(F.col("ts").cast("timestamp_ntz"), "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "value")


@register("ud5_filter_reasons", "SELECT CASE WHEN event_type = 'error' THEN 'type' WHEN value < 10 THEN 'value' ELSE '' END AS reason, count(*) AS n FROM events GROUP BY 1")
def ud5_filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD5: what each of several filters rejected."""
    reason = F.when(F.col("event_type") == "error", "type").when(F.col("value") < 10, "value").otherwise("")
    return table(spark, sf_dir, "events").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
