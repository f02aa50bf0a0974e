"""Series, panels, bars and tapes derived from the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_values(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    """(series_id, <at>, v): order value of each nation and period."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    period = F.to_date("o_orderdate") if at == "day" else F.to_date(F.date_trunc("week", "o_orderdate"))
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    return joined.groupBy(F.col("c_nationkey").alias("series_id"), period.alias(at)).agg(F.sum("o_totalprice").alias("v"))


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, day, idx, v, r): daily order value of each nation and its damped log change (null at first)."""
    w = Window.partitionBy("series_id").orderBy("day")
    rows = nation_values(spark, sf_dir, "day").withColumn("idx", F.row_number().over(w))
    return rows.withColumn("r", F.ln(F.col("v") / F.lag("v").over(w)) / 50)


def event_bars(events: DataFrame, seconds: int) -> DataFrame:
    """OHLCV bars of ``value`` by event_type; ties in time go by event_id. One shuffle, aggregated map-side first."""
    at = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds) * seconds)
    order = F.struct("ts", "event_id")
    return events.groupBy("event_type", at.alias("bar")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", order).alias("close"), F.count(F.lit(1)).alias("volume"),
    )
