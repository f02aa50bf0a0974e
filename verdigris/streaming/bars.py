"""Bars over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_bars(events: DataFrame, length: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """OHLCV bars by event_type over a stream (or a table) of events; state older than ``late`` is let go. The state
    of a bar is one row, whatever number of events falls into it."""
    order = F.struct("ts", "event_id")
    bars = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count(F.lit(1)).alias("volume")
    )
    return bars.select("event_type", F.col("window.start").alias("bar"), "open", "high", "low", "close", "volume")
