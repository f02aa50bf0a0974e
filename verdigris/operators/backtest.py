"""Positions, costs and cross-sectional portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rolling import frame, full

def in_order():
    return Window.partitionBy("series_id").orderBy("idx")


def charge(rows: DataFrame, position: str = "position", r: str = "r", bps: float = 10.0) -> DataFrame:
    """gross = position x return of the row, turnover = change of position, net = gross - turnover x cost."""
    before = F.coalesce(F.lag(position).over(in_order()), F.lit(0))
    return rows.withColumn("turnover", F.abs(F.col(position) - before).cast("double")).withColumn("gross", F.coalesce(F.col(position) * F.col(r), F.lit(0.0))).withColumn("net", F.col("gross") - F.col("turnover") * (bps / 1e4))


def momentum(series: DataFrame, back: int = 30, v: str = "v") -> DataFrame:
    """Position at t: sign of the change over ``back`` rows up to t - 1; 0 without enough rows."""
    change = F.lag(v, 1).over(in_order()) / F.lag(v, 1 + back).over(in_order()) - 1
    return series.withColumn("position", F.coalesce(F.signum(change), F.lit(0.0)).cast("int"))


def crossover(series: DataFrame, fast: int = 5, slow: int = 20, v: str = "v") -> DataFrame:
    """1 where the fast mean lies over the slow one at t - 1, -1 under it, 0 until the slow one is full."""
    a, b, x = frame(fast, 1), frame(slow, 1), F.col(v)
    gap = full(F.avg(x).over(a) - F.avg(x).over(b), x, slow, b)
    return series.withColumn("position", F.coalesce(F.signum(gap), F.lit(0.0)).cast("int"))


def ranked_weights(panel: DataFrame, signal: str, k: int = 5, at: str = "week", by: str = "series_id") -> DataFrame:
    """Equal weights: the ``k`` highest signals of a period long, the ``k`` lowest short, ties by series."""
    up = F.row_number().over(Window.partitionBy(at).orderBy(F.col(signal).desc(), by))
    down = F.row_number().over(Window.partitionBy(at).orderBy(signal, F.col(by).desc()))
    rows = panel.filter(F.col(signal).isNotNull()).withColumn("up", up).withColumn("down", down)
    n = F.count(F.lit(1)).over(Window.partitionBy(at))
    weight: Column = F.when(n < 2 * k, 0.0).when(F.col("up") <= k, 1.0 / k).when(F.col("down") <= k, -1.0 / k).otherwise(0.0)
    return rows.withColumn("weight", weight).drop("up", "down")


def portfolio(weights: DataFrame, forward: str, at: str = "week", by: str = "series_id", bps: float = 10.0) -> DataFrame:
    """Per period: gross return on ``forward``, turnover against the series' last weight, and net of cost."""
    before = F.coalesce(F.lag("weight").over(Window.partitionBy(by).orderBy(at)), F.lit(0.0))
    rows = weights.withColumn("turnover", F.abs(F.col("weight") - before))
    out = rows.groupBy(at).agg(F.sum(F.col("weight") * F.coalesce(F.col(forward), F.lit(0.0))).alias("gross"), F.sum("turnover").alias("turnover"))
    return out.withColumn("net", F.col("gross") - F.col("turnover") * (bps / 1e4 / 2))
