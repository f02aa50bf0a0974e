"""Statistical gates: deflated Sharpe ratios, multiple testing, cross-validated overfitting, calibration."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normal import expected_max, normal_cdf, normal_quantile


def deflated_sharpe(moments: DataFrame, trials: list[int]) -> DataFrame:
    """Probabilistic Sharpe ratio, and that deflated by the best of each number of ``trials``."""
    spark = moments.sparkSession
    grid = spark.createDataFrame([(n, expected_max(n)) for n in trials], "trials int, luck double")
    sr = F.col("sharpe")
    var = F.greatest(1 - F.col("skew") * sr + (F.col("kurtosis") - 1) / 4 * sr * sr, F.lit(1e-12))
    rows = moments.filter("n > 1").withColumn("se", F.sqrt(var / (F.col("n") - 1)))
    # the grid is the parameter's few rows
    rows = rows.join(F.broadcast(grid), F.lit(True))
    return rows.withColumn("psr", normal_cdf(sr / F.col("se"))).withColumn("dsr", normal_cdf((sr - F.col("se") * F.col("luck")) / F.col("se")))


def sharpe_haircuts(moments: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Two-sided p values of the Sharpe ratios with Bonferroni, Holm and Benjamini-Hochberg-Yekutieli adjustment.

    ``holm`` and ``bhy`` are kept monotone in p; ``holm_step`` and ``bhy_step`` are each rank's own. Survivors at
    ``alpha``: ``holm_significant`` until the first failure in order of p, ``bhy_significant`` each rank by itself.
    There is one row a strategy, so the windows over all of them hold as many rows as there are strategies.
    """
    rows = moments.withColumn("p", 2 * (1 - normal_cdf(F.abs(F.col("sharpe") * F.sqrt("n")))))
    every = Window.partitionBy()
    up = Window.orderBy("p", "series_id")
    rows = rows.withColumn("m", F.count(F.lit(1)).over(every)).withColumn("place", F.row_number().over(up))
    harmonic = F.aggregate(F.sequence(F.lit(1), F.col("m").cast("int")), F.lit(0.0), lambda a, i: a + 1 / i)
    rows = rows.withColumn("holm_step", F.col("p") * (F.col("m") - F.col("place") + 1)).withColumn("bhy_step", F.col("p") * F.col("m") * harmonic / F.col("place"))
    back = Window.orderBy(F.col("p").desc(), F.col("series_id").desc())
    one = lambda c: F.least(c, F.lit(1.0))
    rows = rows.withColumn("bonferroni", one(F.col("p") * F.col("m"))).withColumn("holm", one(F.max("holm_step").over(up))).withColumn("bhy", one(F.min("bhy_step").over(back)))
    # no rank up to this one fails if the largest step up to it passes
    rows = rows.withColumn("holm_significant", F.max("holm_step").over(up) <= alpha).withColumn("bhy_significant", F.col("bhy_step") <= alpha)
    return rows.withColumn("holm_step", one(F.col("holm_step"))).withColumn("bhy_step", one(F.col("bhy_step")))


def haircut_sharpes(haircuts: DataFrame) -> DataFrame:
    """``sharpe_haircuts`` with the Sharpe ratio that each adjusted p value would need, of the observed sign (0 at p = 1 and
    under two rows), and the share that is cut off, for Bonferroni's and for each rank's own Holm and BHY values."""
    for name, p in (("bonferroni", "bonferroni"), ("holm", "holm_step"), ("bhy", "bhy_step")):
        size = normal_quantile(1 - F.col(p) / 2) / F.sqrt("n")
        left = F.when((F.col("n") < 2) | (F.col(p) >= 1), 0.0).when(F.col("sharpe") < 0, -size).otherwise(size)
        cut = F.least(F.greatest(1 - F.try_divide(left, F.col("sharpe")), F.lit(0.0)), F.lit(1.0))
        haircuts = haircuts.withColumn(f"{name}_sharpe", left).withColumn(f"{name}_cut", F.when(F.abs("sharpe") > 1e-9, cut).otherwise(0.0))
    return haircuts


def fold_combinations(spark: SparkSession, folds: int) -> DataFrame:
    """(split, fold, train): every choice of half of the ``folds`` for training."""
    rows = [(i, f, f in chosen) for i, chosen in enumerate(combinations(range(folds), folds // 2)) for f in range(folds)]
    return spark.createDataFrame(rows, "split int, fold int, train boolean")


def overfitting(scores: DataFrame, folds: int = 8) -> DataFrame:
    """Combinatorially symmetric cross-validation of ``scores`` (series_id, fold, n, total): per split the series that
    is best in training, its relative rank in test, and the logit of that."""
    splits = fold_combinations(scores.sparkSession, folds)
    mean = lambda cond: F.sum(F.when(cond, F.col("total"))) / F.sum(F.when(cond, F.col("n")))
    each = scores.join(F.broadcast(splits), "fold").groupBy("split", "series_id").agg(mean(F.col("train")).alias("inside"), mean(~F.col("train")).alias("outside"))
    rank = F.row_number().over(Window.partitionBy("split").orderBy("outside", "series_id"))
    first = F.row_number().over(Window.partitionBy("split").orderBy(F.col("inside").desc(), "series_id"))
    rows = each.withColumn("rank", rank).withColumn("first", first).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("split"))).filter("first = 1")
    share = F.col("rank") / (F.col("m") + 1)
    return rows.select("split", "series_id", (share).alias("share"), F.ln(share / (1 - share)).alias("logit"))


def calibration(rows: DataFrame, price: str, won: str, buckets: int = 10) -> DataFrame:
    """By price bucket: n, mean price, win rate and Brier score."""
    bucket = F.least(F.floor(F.col(price) * buckets), F.lit(buckets - 1))
    gap = F.col(price) - F.col(won)
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(price).alias("price"), F.avg(won).alias("rate"), F.avg(gap * gap).alias("brier"))
