"""Pairs of series: regressions of all pairs from blocked cross products, stationarity of their residuals, spread trades."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .carried import carried

SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def pair_regressions(panel: DataFrame, by: str, at: str, x: str, chunk: Column, block: int = 256) -> DataFrame:
    """(a, b, n, beta, alpha, corr) of every pair a < b of series: a's values on b's, at the times that both have.

    Series are dealt to blocks of about ``block`` by hash, and each pair of blocks and ``chunk`` (say, the year of ``at``)
    is one task's matrix product; sums of the chunks are added up. A task holds two blocks over one chunk, and rows are
    copied once for each block there is instead of once for each series. Rows with a null are left out, several values of
    a series at one time averaged, pairs of under two common times left out; beta is 0 where b doesn't vary.
    """
    rows = panel.filter(F.col(by).isNotNull() & F.col(at).isNotNull() & F.col(x).isNotNull()).groupBy(F.col(by).alias("s"), F.col(at).alias("t")).agg(F.avg(x).alias("x"), F.min(chunk).alias("c"))
    kind = dict(rows.dtypes)["s"]
    blocks = max(1, math.ceil(panel.agg(F.approx_count_distinct(by)).first()[0] / block))
    own, other = F.pmod(F.xxhash64("s"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = rows.withColumn("own", own).withColumn("other", other).select("s", "t", "x", "c", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def products(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        lo, hi, _ = key
        times, when = np.unique(part["t"].to_numpy(), return_inverse=True)

        def matrix(mine):
            names, which = np.unique(part["s"].to_numpy()[mine], return_inverse=True)
            values, there = np.zeros((len(times), len(names))), np.zeros((len(times), len(names)))
            values[when[mine], which], there[when[mine], which] = part["x"].to_numpy()[mine], 1.0
            return names, values, there

        p, u, m = matrix((part["own"] == lo).to_numpy())
        q, v, k = matrix((part["own"] == hi).to_numpy())
        n, su, sv, suu, svv, suv = m.T @ k, u.T @ k, m.T @ v, (u * u).T @ k, m.T @ (v * v), u.T @ v
        i, j = np.nonzero(n if lo != hi else np.triu(n, 1))
        swap = p[i] > q[j]
        pick = lambda a, b: np.where(swap, b[i, j], a[i, j])
        return pd.DataFrame({"a": np.where(swap, q[j], p[i]), "b": np.where(swap, p[i], q[j]), "n": n[i, j], "sx": pick(sv, su), "sy": pick(su, sv), "sxx": pick(svv, suu), "syy": pick(suu, svv), "sxy": suv[i, j]})

    parts = dealt.groupBy("lo", "hi", "c").applyInPandas(products, f"a {kind}, b {kind}, " + ", ".join(f"{c} double" for c in SUMS))
    sums = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in SUMS]).filter("n >= 2")
    n, mx, my = F.col("n"), F.col("sx") / F.col("n"), F.col("sy") / F.col("n")
    vx, vy, cov = F.col("sxx") / n - mx * mx, F.col("syy") / n - my * my, F.col("sxy") / n - mx * my
    beta = F.when(vx > 1e-12, F.try_divide(cov, vx)).otherwise(0.0)
    corr = F.when((vx > 1e-12) & (vy > 1e-12), F.try_divide(cov, F.sqrt(vx * vy))).otherwise(0.0)
    return sums.select("a", "b", n.cast("long").alias("n"), beta.alias("beta"), (my - beta * mx).alias("alpha"), corr.alias("corr"))


def pair_rows(panel: DataFrame, pairs: DataFrame, by: str, at: str, x: str) -> DataFrame:
    """``pairs`` with the times that both series have: (…, at, xa, xb)."""
    side = lambda name, value: panel.filter(F.col(x).isNotNull()).groupBy(F.col(by).alias(name), F.col(at).alias("at")).agg(F.avg(x).alias(value))
    return pairs.join(side("a", "xa"), "a").join(side("b", "xb"), ["b", "at"])


def stationarity(rows: DataFrame, by: list[str], order: str, e: str) -> DataFrame:
    """By series: adf, the t value of the level in a regression of the change on level and last change without constant (0
    under 20 rows), and the mean-reverting fit on the value before (null unless its slope is in (0, 1)): kappa, half_life,
    level, sigma_eq. All from sums of lagged products: one window over each series' rows, then one aggregation."""
    w = Window.partitionBy(*by).orderBy(order)
    x = rows.select(*by, F.col(e).alias("y"), F.lag(e).over(w).alias("l1"), F.lag(e, 2).over(w).alias("l2"))
    dy, dl = F.col("y") - F.col("l1"), F.when(F.col("l2").isNotNull(), F.col("l1") - F.col("l2"))
    both = lambda a, b: F.sum(F.when(F.col("l2").isNotNull(), a * b))
    l1, y = F.col("l1"), F.col("y")
    q = x.groupBy(*by).agg(
        F.count("y").alias("rows"), F.count("l2").alias("m"), F.count("l1").alias("c"), both(l1, l1).alias("ll"), both(l1, dl).alias("ld"), both(dl, dl).alias("dd"), both(l1, dy).alias("ly"), both(dl, dy).alias("dy"), both(dy, dy).alias("yy"),
        F.sum(l1).alias("sx"), F.sum(F.when(l1.isNotNull(), y)).alias("sy"), F.sum(l1 * l1).alias("sxx"), F.sum(F.when(l1.isNotNull(), y * y)).alias("syy"), F.sum(l1 * y).alias("sxy"),
    )
    det = F.col("ll") * F.col("dd") - F.col("ld") ** 2
    q = q.withColumn("det", det).withColumns({"rho": F.try_divide(F.col("dd") * F.col("ly") - F.col("ld") * F.col("dy"), F.col("det")), "phi": F.try_divide(F.col("ll") * F.col("dy") - F.col("ld") * F.col("ly"), F.col("det"))})
    sse = F.greatest(F.col("yy") - F.col("rho") * F.col("ly") - F.col("phi") * F.col("dy"), F.lit(0.0))
    error = F.sqrt(F.greatest(F.try_divide(sse / F.greatest(F.col("m") - 2, F.lit(1)) * F.col("dd"), F.col("det")), F.lit(1e-18)))
    adf = F.when((F.col("rows") >= 20) & (F.abs("det") >= 1e-12), F.col("rho") / error).otherwise(0.0)
    slope = F.try_divide(F.col("c") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("c") * F.col("sxx") - F.col("sx") ** 2)
    q = q.withColumn("adf", adf).withColumn("again", F.when((F.col("rows") >= 20) & (slope > 0) & (slope < 1), slope))
    a, b, c = (F.col("sy") - F.col("again") * F.col("sx")) / F.col("c"), F.col("again"), F.col("c")
    left = F.col("syy") - a * F.col("sy") - b * F.col("sxy")
    return q.select(*by, "rows", "adf", (-F.ln(b)).alias("kappa"), (math.log(2) / -F.ln(b)).alias("half_life"), (a / (1 - b)).alias("level"), F.sqrt(F.greatest(left / (c - 2) / (1 - b * b), F.lit(1e-18))).alias("sigma_eq"))


def spread_trades(rows: DataFrame, window: int = 60, entry: float = 2.0, leave: float = 0.0, cost: float = 0.0028) -> DataFrame:
    """(pair, at, z, position, closed, net) for ``rows`` (a, b, at, xa, xb: logarithms of prices): the spread of a over its
    regression on b in the ``window`` rows before is sold over ``entry`` deviations, bought under them, and left at ``leave``;
    a position earns from the next row on. Returns are for a gross exposure of one, ``cost`` is that of a round trip, and
    ``closed`` holds a finished trade's rows. What is known before a row alone decides it."""
    w = Window.partitionBy("pair").orderBy("at")
    back = w.rowsBetween(-window, -1)
    x, y = F.col("xb"), F.col("xa")
    r = rows.withColumn("pair", F.struct("a", "b")).withColumns({"var": F.var_samp(x).over(back), "cov": F.covar_samp(x, y).over(back), "vary": F.var_samp(y).over(back), "mx": F.avg(x).over(back), "my": F.avg(y).over(back), "lx": F.lag(x).over(w), "ly": F.lag(y).over(w), "place": F.row_number().over(w)})
    r = r.withColumn("slope", F.when(F.col("var") > 1e-12, F.try_divide(F.col("cov"), F.col("var"))).otherwise(0.0))
    sd = F.sqrt(F.greatest(F.col("vary") - F.col("slope") * F.col("cov"), F.lit(0.0)))
    gap = F.col("ly") - F.col("my") - F.col("slope") * (F.col("lx") - F.col("mx"))
    z = F.when(F.col("place") > window + 1, F.when(sd > 1e-9, F.try_divide(gap, sd)).otherwise(0.0))
    gain = (F.exp(y - F.col("ly")) - 1 - F.col("slope") * (F.exp(x - F.col("lx")) - 1)) / (1 + F.abs("slope"))
    ready = r.select("pair", "at", z.alias("z"), gain.alias("gain"))

    def machine():
        side = held = 0

        def step(z, gain):
            nonlocal side, held
            if z is None:
                return z, 0, None, 0.0
            last = side
            if side == 0:
                side = -1 if z > entry else 1 if z < -entry else 0
            elif side * z >= -leave:
                side = 0
            closed = held if last and not side else None
            held = held + 1 if side else 0
            return z, side, closed, last * gain - abs(side - last) / 2 * cost

        return step

    return carried(ready, "pair", "at", ["z", "gain"], "z double, position int, closed int, net double", machine)
