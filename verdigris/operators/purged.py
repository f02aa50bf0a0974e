"""Combinatorial purged cross-validation: paths of returns that no choice has seen, their score, and odds of overfitting."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POWERS = ("n", "s1", "s2", "s3", "s4", "gain")


def path_plan(spark: SparkSession, folds: int, held: int) -> DataFrame:
    """(split, fold, path, before, after) for each choice of ``held`` of the ``folds`` as test: path numbers a test fold's
    splits (null: a training fold); before and after tell whether the next and the last fold are tested."""
    rows, used = [], [0] * folds
    for split, chosen in enumerate(combinations(range(folds), held)):
        for fold in range(folds):
            path = used[fold] if fold in chosen else None
            used[fold] += fold in chosen
            rows.append((split, fold, path, fold + 1 in chosen, fold - 1 in chosen))
    return spark.createDataFrame(rows, "split int, fold int, path int, before boolean, after boolean")


def power_sums(x: Column) -> list[Column]:
    """Count, sums of four powers and log growth of ``x``; a loss of everything grows by minus infinity."""
    growth = F.when(x > -1, F.ln(1 + x)).when(x.isNotNull(), F.lit(-math.inf))
    return [F.count(x).alias("n"), *[F.coalesce(F.sum(x**k if k > 1 else x), F.lit(0.0)).alias(f"s{k}") for k in (1, 2, 3, 4)], F.coalesce(F.sum(growth), F.lit(0.0)).alias("gain")]


def added() -> list[Column]:
    return [F.sum(c).alias(c) for c in POWERS]


def deviation() -> Column:
    n, s1 = F.col("n"), F.col("s1")
    return F.when(n > 1, F.sqrt(F.greatest(F.try_divide(F.col("s2") - s1 * F.try_divide(s1, n), n - 1), F.lit(0.0)))).otherwise(0.0)


def sharpe() -> Column:
    return F.when(deviation() > 1e-12, F.try_divide(F.col("s1"), F.col("n") * deviation())).otherwise(0.0)


def cpcv_paths(grid: DataFrame, by: str, folds: int = 6, held: int = 2, purge: int = 1, embargo: int = 5) -> DataFrame:
    """(by, path, n, s1 to s4, gain, sharpe, total) from ``grid`` (by, param, at, net): ``at`` counts rows without gaps.

    A series' times are cut into equal folds. In each split the parameter with the best Sharpe ratio in training is used
    on the test folds (of several the smallest); a path takes each fold's test from another split. Training leaves out
    ``purge`` rows on either side of a test fold and ``embargo`` more behind it. The table is aggregated once, by fold and
    by nearness to its ends; all splits are sums of these few rows. Series of fewer rows than folds have fewer folds.
    """
    ends = grid.groupBy(by).agg(F.min("at").alias("first"), (F.max("at") - F.min("at") + 1).alias("rows"))
    p, rows = F.col("at") - F.col("first"), F.col("rows")
    start = lambda f: F.ceil(f * rows / folds)
    cut = grid.join(ends, by).withColumn("fold", F.floor(p * folds / rows).cast("int"))
    cut = cut.withColumns({"head": p - start(F.col("fold")) < purge + embargo, "tail": start(F.col("fold") + 1) - 1 - p < purge})
    sums = cut.groupBy(by, "param", "fold", "head", "tail").agg(*power_sums(F.col("net")))
    # the plan is a table of the parameters alone
    each = sums.join(F.broadcast(path_plan(grid.sparkSession, folds, held)), "fold")
    seen = each.filter("path IS NULL AND NOT (head AND after) AND NOT (tail AND before)").groupBy(by, "split", "param").agg(*added())
    best = F.max(F.struct(F.round(sharpe(), 9).alias("sharpe"), (-F.col("param")).alias("low")))
    chosen = seen.groupBy(by, "split").agg(best.alias("best")).select(by, "split", (-F.col("best.low")).alias("param"))
    paths = each.filter("path IS NOT NULL").join(chosen, [by, "split", "param"]).groupBy(by, "path").agg(*added())
    return paths.withColumns({"sharpe": sharpe(), "total": F.exp("gain") - 1})


def path_scores(paths: DataFrame, by: str, worst: float = 0.45, spread: float = 0.5, bonus: float = 0.3) -> DataFrame:
    """By series: median, worst, best and deviation of its paths' Sharpe ratios, share of paths that gain, median and worst
    total, rows of all paths, and the score: medians weigh 1 - ``worst``, the worst path ``worst``, less ``spread`` for each
    unit of deviation, plus ``bonus`` for the share that gains. The moments are those of all paths' returns together."""
    rows = paths.groupBy(by).agg(
        F.count(F.lit(1)).alias("paths"), F.median("sharpe").alias("median_sharpe"), F.min("sharpe").alias("worst_sharpe"), F.max("sharpe").alias("best_sharpe"), F.coalesce(F.stddev_samp("sharpe"), F.lit(0.0)).alias("dispersion"),
        F.avg((F.col("total") > 0).cast("double")).alias("positive"), F.median("total").alias("median_total"), F.min("total").alias("worst_total"), *added(),
    )
    score = F.col("median_sharpe") * max(0.0, 1 - worst) + F.col("worst_sharpe") * worst - F.col("dispersion") * spread + F.col("positive") * bonus
    m, s, flat = F.try_divide(F.col("s1"), F.col("n")), deviation(), deviation() <= 1e-12
    raw = [F.try_divide(F.col(f"s{k}"), F.col("n")) for k in (2, 3, 4)]
    third, fourth = raw[1] - 3 * m * raw[0] + 2 * m**3, raw[2] - 4 * m * raw[1] + 6 * m**2 * raw[0] - 3 * m**4
    return rows.withColumns({
        "score": score, "sharpe": sharpe(),
        "skew": F.when(flat | (F.col("n") < 3), 0.0).otherwise(F.try_divide(third, s**3)),
        "kurtosis": F.when(flat | (F.col("n") < 4), 3.0).otherwise(F.try_divide(fourth, s**4)),
    }).drop("s1", "s2", "s3", "s4", "gain")


def overfit_odds(scores: DataFrame, by: str, fold: str, gain: str, folds: int, share: float = 0.5) -> DataFrame:
    """One row for a table of log growth by strategy and fold (0 to ``folds`` - 1; a missing one grows by 0): strategies,
    folds, splits, pbo (share of splits whose best strategy in training lies in the lower half in test), mean and median
    logit of its place in test (1 the best of all, 0 the last, 1e-12 off either end). Ties go to the smallest strategy.

    The place is a count of better ones, so no split is sorted; without strategies or with fewer than two folds, no splits.
    """
    spark = scores.sparkSession
    size = max(1, min(folds - 1, math.floor(folds * min(0.9, max(0.1, share)) + 0.5)))
    plan = [(i, f, f in chosen) for i, chosen in enumerate(combinations(range(folds), size)) for f in range(folds)] if folds > 1 else []
    splits = spark.createDataFrame(plan, "split int, _fold int, train boolean")
    rows = scores.select(F.col(by).alias("s"), F.col(fold).alias("_fold"), F.col(gain).alias("g"))
    part = lambda cond: F.round(F.coalesce(F.sum(F.when(cond, F.col("g"))), F.lit(0.0)), 9)
    each = rows.join(F.broadcast(splits), "_fold").groupBy("split", "s").agg(part(F.col("train")).alias("inside"), part(~F.col("train")).alias("outside"))
    top = each.groupBy("split").agg(F.max("inside").alias("inside"))
    # as many rows as there are splits, which the parameters bound
    best = each.join(F.broadcast(top), ["split", "inside"]).groupBy("split").agg(F.min(F.struct("s", "outside")).alias("c"))
    placed = each.join(F.broadcast(best), "split").groupBy("split").agg(
        F.count(F.lit(1)).alias("m"), F.count_if((F.col("outside") > F.col("c.outside")) | ((F.col("outside") == F.col("c.outside")) & (F.col("s") < F.col("c.s")))).alias("better"))
    place = F.when(F.col("m") > 1, 1 - F.col("better") / (F.col("m") - 1)).otherwise(0.5)
    place = F.least(F.greatest(place, F.lit(1e-12)), F.lit(1 - 1e-12))
    logit = placed.select("m", F.ln(place / (1 - place)).alias("logit"))
    return logit.agg(F.coalesce(F.max("m"), F.lit(0)).alias("strategies"), F.lit(folds).alias("folds"), F.count("logit").alias("splits"), F.coalesce(F.avg((F.col("logit") < 0).cast("double")), F.lit(0.0)).alias("pbo"), F.coalesce(F.avg("logit"), F.lit(0.0)).alias("mean_logit"), F.coalesce(F.median("logit"), F.lit(0.0)).alias("median_logit"))
