"""Bounded-frame indicators over series and bars: window expressions, so one shuffle by series whatever their number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rolling import frame, full


def moving_statistics(series: DataFrame, n: int = 20, v: str = "v") -> DataFrame:
    """partial_mean and z (n) over up to ``n`` rows; full_mean, highest and lowest only once there are ``n``."""
    w, x = frame(n), F.col(v)
    sd = F.stddev_pop(x).over(w)
    return series.withColumns({
        "partial_mean": F.avg(x).over(w), "full_mean": full(F.avg(x).over(w), x, n, w), "highest": full(F.max(x).over(w), x, n, w), "lowest": full(F.min(x).over(w), x, n, w),
        "z": F.when(sd > 1e-12, F.try_divide(x - F.avg(x).over(w), sd)).otherwise(0.0),
    })


def prior_bands(series: DataFrame, n: int = 20, mult: float = 2.0, v: str = "v") -> DataFrame:
    """Channel and mean plus and minus ``mult`` deviations of the ``n`` rows before, and entry: 1 or -1 on a close
    beyond the channel; null until there are ``n`` rows."""
    w, x = frame(n, 1), F.col(v)
    seen = lambda c: full(c, x, n, w)
    rows = series.withColumns({"mid": seen(F.avg(x).over(w)), "spread": seen(F.stddev_pop(x).over(w)), "top": seen(F.max(x).over(w)), "bottom": seen(F.min(x).over(w))})
    rows = rows.withColumns({"upper": F.col("mid") + mult * F.col("spread"), "lower": F.col("mid") - mult * F.col("spread")})
    return rows.withColumn("entry", F.when(x > F.col("top"), 1).when(x < F.col("bottom"), -1).otherwise(0))


def floor_pivots(bars: DataFrame, by: str, order: str) -> DataFrame:
    """Pivot and two supports and resistances from the bar before; null for a series' first bar."""
    w = Window.partitionBy(by).orderBy(order)
    high, low, close = (F.lag(c).over(w) for c in ("high", "low", "close"))
    rows = bars.withColumns({"pp": (high + low + close) / 3, "_high": high, "_low": low})
    pp, high, low = F.col("pp"), F.col("_high"), F.col("_low")
    return rows.withColumns({"r1": 2 * pp - low, "s1": 2 * pp - high, "r2": pp + high - low, "s2": pp - high + low}).drop("_high", "_low")


def stochastic(series: DataFrame, n: int = 14, smooth: int = 3, v: str = "v") -> DataFrame:
    """Place of a close within its ``n``-row range in percent (50 if flat), and its mean over ``smooth`` rows."""
    w, s, x = frame(n), frame(smooth), F.col(v)
    low, high = F.min(x).over(w), F.max(x).over(w)
    rows = series.withColumn("raw_k", full(F.when(high > low, F.try_divide(100 * (x - low), high - low)).otherwise(50.0), x, n, w))
    return rows.withColumn("k", full(F.avg("raw_k").over(s), F.col("raw_k"), smooth, s))


def channel_index(bars: DataFrame, by: str, order: str, n: int = 20) -> DataFrame:
    """Typical price less its mean over ``n`` bars, over 0.015 mean absolute deviations (0 if flat)."""
    w = frame(n, by=by, order=order)
    rows = bars.withColumn("tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    mean, held = F.avg("tp").over(w), F.collect_list("tp").over(w)
    rows = rows.withColumns({"mean": full(mean, F.col("tp"), n, w), "held": held})
    rows = rows.withColumn("mad", F.aggregate("held", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("mean"))) / n)
    return rows.withColumn("cci", F.when(F.col("mean").isNull(), None).when(F.col("mad") > 1e-12, (F.col("tp") - F.col("mean")) / (0.015 * F.col("mad"))).otherwise(0.0)).drop("held")


def true_range(bars: DataFrame, by: str, order: str, n: int = 14) -> DataFrame:
    """True range of each bar that has one before, and atr: the mean of the ranges there are among the last ``n`` bars,
    or high less low on the first bar."""
    last = F.lag("close").over(Window.partitionBy(by).orderBy(order))
    rows = bars.withColumn("tr", F.when(last.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last))))
    return rows.withColumn("atr", F.coalesce(F.avg("tr").over(frame(n, by=by, order=order)), F.col("high") - F.col("low")))


def annual_sharpe(series: DataFrame, by: str, r: str = "r", year: int = 365) -> DataFrame:
    """Mean over deviation (n - 1) times the root of a year's rows; 0 for a flat series."""
    sd = F.coalesce(F.stddev_samp(r), F.lit(0.0))
    return series.groupBy(by).agg(F.count(r).alias("n"), F.when(sd > 1e-12, F.avg(r) / sd * F.sqrt(F.lit(float(year)))).otherwise(0.0).alias("sharpe"))


def ordinal_spearman(rows: DataFrame, by: str, x: str, y: str, tie: str) -> DataFrame:
    """Correlation of ordinal ranks; equal values are told apart by ``tie`` and not averaged."""
    ranks = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(by, *[F.row_number().over(Window.partitionBy(by).orderBy(c, tie)).cast("double").alias(f"k{i}") for i, c in enumerate((x, y))])
    return ranks.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.corr("k0", "k1").alias("spearman"))


def slope_t(rows: DataFrame, by: str, x: str, y: str, least: int = 10) -> DataFrame:
    """n, slope and t value of the least-squares line of ``y`` on ``x``; groups of under ``least`` rows have none:
    0 would read as no effect."""
    out = rows.groupBy(by).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("b"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"))
    left = F.greatest(F.col("syy") - F.col("b") ** 2 * F.col("sxx"), F.lit(0.0))
    error = F.sqrt(left / (F.col("n") - 2) / F.col("sxx"))
    enough = (F.col("n") >= least) & (F.col("sxx") > 0)
    return out.select(by, "n", F.when(enough, F.col("b")).alias("beta"), F.when(enough & (error > 0), F.col("b") / error).alias("t"))


def week_closes(series: DataFrame, by: str, day: str, v: str) -> DataFrame:
    """The last value of each week from Monday, and its change from the week before; null if that week has none."""
    weeks = series.groupBy(by, F.to_date(F.date_trunc("week", day)).alias("week")).agg(F.max_by(v, day).alias("close"))
    w = Window.partitionBy(by).orderBy("week")
    next_to = F.date_sub("week", 7) == F.lag("week").over(w)
    return weeks.withColumn("change", F.when(next_to, F.try_divide("close", F.lag("close").over(w)) - 1))


def yearly_rates(series: DataFrame, by: str, day: str, r: str, year: int = 365) -> DataFrame:
    """Each year's annual rate: the mean over series of their mean changes times a year's rows, every series alike
    whatever its rows; and the series and changes behind it."""
    each = series.filter(F.col(r).isNotNull()).groupBy(by, F.year(day).cast("long").alias("year")).agg(F.count(r).alias("n"), (F.avg(r) * year).alias("apr"))
    return each.groupBy("year").agg(F.count(F.lit(1)).alias("series"), F.sum("n").alias("n"), F.avg("apr").alias("apr"))
