"""Structured Streaming forms of batch operators; an extension, labelled as such in the README."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """``ts`` as a zoned timestamp, which watermarks need."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_outcomes(events: DataFrame, ts: str, by: list[str], success: Column, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts and success rate per group and tumbling window; rows later than ``late`` are left out."""
    g = event_time(events, ts).withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *by)
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg(success.cast("double")).alias("success_rate")).select(F.col("w.start").alias("start"), *by, "n", "success_rate")


def first_seen(events: DataFrame, ts: str, key: list[str], late: str = "30 minutes") -> DataFrame:
    """First row of each key within the watermark; state is bounded by it."""
    return event_time(events, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark(key)
