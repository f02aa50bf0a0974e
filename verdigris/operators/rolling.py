"""Rows-framed window operators and recurrences over each series."""

from __future__ import annotations

from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frame(n: int, lag: int = 0, by: str = "series_id", order: str = "idx"):
    """The ``n`` rows that end ``lag`` rows back."""
    return Window.partitionBy(by).orderBy(order).rowsBetween(-(n - 1) - lag, -lag)


def full(value: Column, counted: Column, n: int, w) -> Column:
    """``value`` where the frame has ``n`` values, else null."""
    return F.when(F.count(counted).over(w) == n, value)


def rolling_statistics(series: DataFrame, fast: int = 20, slow: int = 60, v: str = "v") -> DataFrame:
    """Mean and deviation (n) over ``fast`` rows, and the z score (n - 1) over ``slow``, null until they are full."""
    a, b, x = frame(fast), frame(slow), F.col(v)
    sd = F.stddev_samp(x).over(b)
    return series.withColumns({
        "sma": full(F.avg(x).over(a), x, fast, a),
        "sd": full(F.stddev_pop(x).over(a), x, fast, a),
        "z": full(F.when(sd > 0, F.try_divide(x - F.avg(x).over(b), sd)).otherwise(0.0), x, slow, b),
    })


def donchian_state(series: DataFrame, n: int = 20, v: str = "v") -> DataFrame:
    """1 after a break above the prior ``n`` rows' high, -1 after one below their low, held until the opposite."""
    prior, x = frame(n, 1), F.col(v)
    signal = F.when(F.count(x).over(prior) == n, F.when(x > F.max(x).over(prior), 1).when(x < F.min(x).over(prior), -1))
    held = F.last("signal", ignorenulls=True).over(Window.partitionBy("series_id").orderBy("idx"))
    return series.withColumn("signal", signal).withColumn("position", F.coalesce(held, F.lit(0))).drop("signal")


def volatility_regime(series: DataFrame, n: int = 20, back: int = 60, r: str = "r") -> DataFrame:
    """high or low as the ``n``-row deviation lies over or under its own median over ``back`` rows; else unknown."""
    w, own = frame(n), frame(back)
    rows = series.withColumn("vol", full(F.stddev_samp(r).over(w), F.col(r), n, w))
    mid = full(F.percentile("vol", F.lit(0.5)).over(own), F.col("vol"), back, own)
    return rows.withColumn("mid", mid).withColumn("regime", F.when(F.col("mid").isNull(), "unknown").when(F.col("vol") > F.col("mid"), "high").otherwise("low"))


def expanding_regime(series: DataFrame, n: int = 20, flat: float = 0.0, r: str = "r", by: str = "series_id", order: str = "idx") -> DataFrame:
    """(by, order, vol, mid, regime) of each row: up, down or flat as the mean of the last ``n`` values lies beyond
    ``flat``, and high or low as their deviation lies over the median of all earlier deviations, its own not included.

    Rows before the window is full are flat_low, as is the first full one's deviation. A null in a window leaves it not
    full. The median grows with each row, so each series is one Arrow group in order and must fit in memory; series are
    spread over tasks.
    """
    kind = dict(series.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        window = rows[r].rolling(n)
        mean, vol = window.mean(), window.std()
        before: list[float] = []
        mids = []
        for x in vol:
            k = len(before)
            mids.append((before[k // 2] + before[(k - 1) // 2]) / 2 if k else None)
            if not np.isnan(x):
                insort(before, x)
        mid = pd.Series(mids, index=rows.index, dtype=float)
        trend = np.where(mean > flat, "up", np.where(mean < -flat, "down", "flat"))
        regime = pd.Series(trend, index=rows.index) + np.where(vol > mid, "_high", "_low")
        return pd.DataFrame({by: rows[by], order: rows[order], "vol": vol, "mid": mid, "regime": regime})

    return series.select(by, order, r).groupBy(by).applyInPandas(run, f"{by} {kind[by]}, {order} {kind[order]}, vol double, mid double, regime string")


def recurrent(series: DataFrame, v: str = "v", n: int = 14, by: str = "series_id", order: str = "idx") -> DataFrame:
    """(by, order, v, ema, rsi): exponential mean with weight 2 / (n + 1) from the first value on, and Wilder's relative
    strength index with weight 1 / n from the first change on, null before row n + 1; 100 without losses.

    The value depends on the last row's output, so each series is one Arrow group in order; a series must fit in
    memory, and series are spread over tasks. A null carries the last mean on.
    """
    kind = dict(series.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        mean = lambda x, k: x.ewm(alpha=k, adjust=False, ignore_na=True).mean()
        change = rows[v].diff()
        up, down = mean(change.clip(lower=0), 1 / n), mean(-change.clip(upper=0), 1 / n)
        rsi = (100 - 100 / (1 + up / down.where(down > 0))).where(down > 0, 100.0)
        return rows.assign(ema=mean(rows[v], 2 / (n + 1)), rsi=rsi.where(np.arange(len(rows)) >= n))

    return series.select(by, order, v).groupBy(by).applyInPandas(run, f"{by} {kind[by]}, {order} {kind[order]}, {v} double, ema double, rsi double")
