"""Rolling covariance matrices from windowed cross moments, and the weights of portfolios that they give."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trailing_covariances(panel: DataFrame, by: str, at: str, r: str, n: int = 26, shrink: float = 0.1) -> DataFrame:
    """(at, a, b, cov) for a <= b: sample covariances over the ``n`` rows before each time, off the diagonal times
    1 - ``shrink``. ``panel`` has a row for each series and time of one grid; a pair with a null in its window, or with
    fewer rows before, has none. Each pair of series is a window of its own; rows are as many as the matrices' entries.
    Rows with a null series or time are left out."""
    rows = panel.filter(F.col(by).isNotNull() & F.col(at).isNotNull())
    side = lambda name, value: rows.select(F.col(at).alias("at"), F.col(by).alias(name), F.col(r).alias(value))
    both = side("a", "x").join(side("b", "y"), "at").filter("a <= b")
    back = Window.partitionBy("a", "b").orderBy("at").rowsBetween(-n, -1)
    full = F.count(F.col("x") + F.col("y")).over(back) == n
    cov = F.covar_samp("x", "y").over(back) * F.when(F.col("a") == F.col("b"), 1.0).otherwise(1 - shrink)
    return both.select("at", "a", "b", F.when(full, cov).alias("cov")).filter("cov IS NOT NULL")


def inverse_volatility(covariances: DataFrame, least: float = 1e-9) -> DataFrame:
    """(at, series, weight): the inverse of each series' deviation, kept at ``least`` or more, as a share of their sum."""
    rows = covariances.filter("a = b").select("at", F.col("a").alias("series"), (1 / F.greatest(F.sqrt("cov"), F.lit(least))).alias("inverse"))
    total = rows.groupBy("at").agg(F.sum("inverse").alias("total"))
    return rows.join(total, "at").select("at", "series", (F.col("inverse") / F.col("total")).alias("weight"))


def equal_risk(cov: np.ndarray, passes: int = 500, near: float = 1e-10) -> tuple[np.ndarray, bool]:
    """Positive weights that sum to one and carry equal shares of the variance, and whether these are met within ``near``.

    They are the least of half the variance less the mean logarithm of the weights, scaled: each coordinate in turn takes
    the positive root of its own quadratic equation. The problem is convex, so any start leads there."""
    n = len(cov)
    scale = np.sqrt(np.diag(cov))
    c = cov / np.outer(scale, scale)
    w = np.full(n, 1 / np.sqrt(n))
    for _ in range(passes):
        for i in range(n):
            rest = c[i] @ w - c[i, i] * w[i]
            w[i] = (np.sqrt(rest * rest + 4 * c[i, i] / n) - rest) / (2 * c[i, i])
        shares = w * (c @ w)
        if np.abs(shares / shares.sum() - 1 / n).max() <= near:
            break
    shares = w * (c @ w)
    out = w / scale
    return out / out.sum(), bool(np.abs(shares / shares.sum() - 1 / n).max() <= near)


def equal_risk_weights(covariances: DataFrame) -> DataFrame:
    """(at, series, weight, share, met) of ``covariances``: weights of equal risk at each time, each one's share of the
    variance, and whether shares are equal to 1e-10. Series without variance are left out; a time is one task's matrix."""
    kinds = dict(covariances.dtypes)

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        names = np.sort(part.loc[(part["a"] == part["b"]) & (part["cov"] > 1e-18), "a"].to_numpy())
        kept = part[part["a"].isin(names) & part["b"].isin(names)]
        i, j = np.searchsorted(names, kept["a"].to_numpy()), np.searchsorted(names, kept["b"].to_numpy())
        cov = np.zeros((len(names), len(names)))
        cov[i, j] = cov[j, i] = kept["cov"].to_numpy()
        w, met = equal_risk(cov) if len(names) else (np.zeros(0), True)
        shares = w * (cov @ w)
        return pd.DataFrame({"at": [part["at"].iloc[0]] * len(names), "series": names, "weight": w, "share": shares / shares.sum() if len(names) else shares, "met": met})

    return covariances.groupBy("at").applyInPandas(solve, f"at {kinds['at']}, series {kinds['a']}, weight double, share double, met boolean")


def weighted_returns(weights: DataFrame, panel: DataFrame, by: str, at: str, r: str, cost: float = 0.001) -> DataFrame:
    """(at, gross, turnover, net): the return of each time's weights on that time's returns (null: 0), the sum of their
    changes from the series' last weight, and what is left after ``cost`` for each unit of it."""
    before = F.coalesce(F.lag("weight").over(Window.partitionBy("series").orderBy("at")), F.lit(0.0))
    rows = weights.select("at", "series", "weight").withColumn("moved", F.abs(F.col("weight") - before))
    own = panel.select(F.col(at).alias("at"), F.col(by).alias("series"), F.col(r).alias("_r"))
    out = rows.join(own, ["at", "series"], "left").groupBy("at").agg(F.sum(F.col("weight") * F.coalesce("_r", F.lit(0.0))).alias("gross"), F.sum("moved").alias("turnover"))
    return out.withColumn("net", F.col("gross") - cost * F.col("turnover"))
