"""Aggregates over return series: moments, drawdown, tail means, histograms, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compound(r: Column) -> Column:
    """exp(sum of log1p) - 1; -1 once any return is -1 or less."""
    safe = F.when(r > -1, F.log1p(r))
    return F.when(F.min(r) <= -1, F.lit(-1.0)).otherwise(F.expm1(F.sum(safe)))


def return_moments(series: DataFrame, by: str = "series_id", r: str = "r") -> DataFrame:
    """n, mean, sd (n - 1), sharpe, skew, kurtosis (not excess), positive rate, total, least and largest of each series.

    Power sums, so one partial aggregation and one small shuffle whatever a series' length. Nulls don't count; a flat
    series has sharpe 0, skew 0 and kurtosis 3.
    """
    x = F.col(r)
    rows = series.filter(x.isNotNull()).groupBy(by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("sd"), F.avg(x * x).alias("m2"), F.avg(x * x * x).alias("m3"), F.avg(x * x * x * x).alias("m4"),
        F.avg((x > 0).cast("double")).alias("positive_rate"), compound(x).alias("total"), F.min(x).alias("least"), F.max(x).alias("largest"),
    )
    m, s, flat = F.col("mean"), F.col("sd"), F.col("sd") <= 1e-12
    third = F.col("m3") - 3 * m * F.col("m2") + 2 * m**3
    fourth = F.col("m4") - 4 * m * F.col("m3") + 6 * m**2 * F.col("m2") - 3 * m**4
    return rows.withColumns({
        "sharpe": F.when(flat, 0.0).otherwise(F.try_divide(m, s)),
        "skew": F.when(flat | (F.col("n") < 3), 0.0).otherwise(F.try_divide(third, s**3)),
        "kurtosis": F.when(flat | (F.col("n") < 4), 3.0).otherwise(F.try_divide(fourth, s**4)),
    }).drop("m2", "m3", "m4")


def drawdown(series: DataFrame, by: str = "series_id", order: str = "idx", r: str = "r", year: int = 365) -> DataFrame:
    """total, annual return, largest drawdown (1 - equity / peak, the peak at least 1) and Calmar ratio. A return
    of -1 or less is ruin: total and annual return are -1 and the drawdown is 1 from there on."""
    w = Window.partitionBy(by).orderBy(order)
    ruined = F.max((F.col(r) <= -1).cast("int")).over(w) == 1
    rows = series.filter(F.col(r).isNotNull()).withColumn("level", F.sum(F.when(F.col(r) > -1, F.log1p(r))).over(w)).withColumn("ruined", ruined)
    rows = rows.withColumn("peak", F.greatest(F.max("level").over(w), F.lit(0.0)))
    fall = F.when(F.col("ruined"), 1.0).otherwise(1 - F.exp(F.col("level") - F.col("peak")))
    out = rows.groupBy(by).agg(compound(F.col(r)).alias("total"), F.count(F.lit(1)).alias("n"), F.max(fall).alias("max_drawdown"))
    annual = F.pow(1 + F.col("total"), F.lit(float(year)) / F.col("n")) - 1
    return out.withColumn("annual", annual).withColumn("calmar", F.try_divide("annual", "max_drawdown"))


def tail_mean(series: DataFrame, q: float = 0.05, by: str = "series_id", r: str = "r", order: str = "idx") -> DataFrame:
    """Mean of the worst max(1, floor(n q)) returns of each series."""
    rows = series.filter(F.col(r).isNotNull())
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(r, order)))
    rows = rows.withColumn("k", F.greatest(F.floor(F.count(F.lit(1)).over(Window.partitionBy(by)) * q), F.lit(1)))
    return rows.filter("place <= k").groupBy(by).agg(F.avg(r).alias("cvar"), F.count(F.lit(1)).alias("k"))


def series_quality(series: DataFrame, by: str = "series_id", value: str = "r", warn: float = 0.01, fail: float = 0.2, wide: float = 8.0) -> DataFrame:
    """n, missing share, median, median absolute deviation, outliers beyond ``wide`` deviations, and a grade."""
    mid = series.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(value).isNull().cast("double")).alias("missing"), F.median(value).alias("median"))
    rows = series.select(by, value).join(mid, by)
    dev = F.abs(F.col(value) - F.col("median"))
    mad = rows.groupBy(by).agg(F.median(dev).alias("mad"))
    out = rows.join(mad, by).groupBy(by, "n", "missing", "median", "mad").agg(F.count_if((F.col("mad") > 0) & (dev / F.when(F.col("mad") > 0, F.col("mad")) > wide)).alias("outliers"))
    grade = F.when(F.col("missing") >= fail, "FAIL").when((F.col("missing") >= warn) | (F.col("outliers") > 0), "WARN").otherwise("PASS")
    return out.withColumn("grade", grade)


def concentration(rows: DataFrame, by: str, part: str, value: str) -> DataFrame:
    """Largest absolute share of a part, and the Herfindahl index of the shares."""
    parts = rows.groupBy(by, part).agg(F.abs(F.sum(value)).alias("x"))
    return parts.groupBy(by).agg(F.count(F.lit(1)).alias("parts"), F.try_divide(F.max("x"), F.sum("x")).alias("largest_share"), F.try_divide(F.sum(F.col("x") * F.col("x")), F.sum("x") * F.sum("x")).alias("hhi"))


def transitions(events: DataFrame, by: str, order: list[str], state: str) -> DataFrame:
    """Counts of one state after another within ``by``, and their share of the first state's."""
    w = Window.partitionBy(by).orderBy(*order)
    pairs = events.select(state, F.lead(state).over(w).alias("next")).filter("next IS NOT NULL").groupBy(F.col(state).alias("state"), "next").agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("state")))
