"""Choices made on what is complete at the time: higher-timeframe bias and walk-forward parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def higher_bias(series: DataFrame, by: str, order: str, r: str, k: int, flat: float = 0.0) -> DataFrame:
    """Add bias: up, down or flat by the summed change of the last bucket of ``k`` rows that was complete before the row's
    own began; flat in the first one. A null change counts as 0. Buckets are summed first and joined by number, so the
    shuffle beyond the numbering is a row a bucket."""
    rows = series.withColumn("_bucket", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / k))
    change = F.sum(F.coalesce(F.col(r), F.lit(0.0)))
    before = rows.groupBy(F.col(by).alias("_by"), (F.col("_bucket") + 1).alias("_next")).agg(F.when(change > flat, "up").when(change < -flat, "down").otherwise("flat").alias("bias"))
    rows = rows.join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_bucket") == F.col("_next")), "left")
    return rows.withColumn("bias", F.coalesce("bias", F.lit("flat"))).drop("_bucket", "_by", "_next")


def bias_gate(positions: DataFrame, position: str, bias: str, block_on_flat: bool = False) -> DataFrame:
    """Add gated: the position where the bias allows its side, else 0. A flat or null bias allows both unless
    ``block_on_flat``."""
    side = F.signum(position)
    allowed = ((side > 0) & (F.col(bias) == "up")) | ((side < 0) & (F.col(bias) == "down"))
    if not block_on_flat:
        allowed = allowed | (F.coalesce(bias, F.lit("flat")) == "flat")
    return positions.withColumn("gated", F.when(allowed, F.col(position)).otherwise(F.lit(0.0)))


def grid_returns(series: DataFrame, by: str, order: str, v: str, spans: list[int], cost: float) -> DataFrame:
    """(by, param, at, net) for every span: the change from the row before, held where that row's close was over its
    mean over the span, less ``cost`` for each unit of position changed. All spans are windows over one sort."""
    w = Window.partitionBy(by).orderBy(order)
    rows = series.withColumn("at", (F.row_number().over(w) - 1).cast("long")).withColumn("change", F.try_divide(F.col(v), F.lag(v).over(w)) - 1)
    over = lambda n: F.when(F.col("at") >= n - 1, (F.col(v) > F.avg(v).over(w.rowsBetween(1 - n, 0))).cast("double")).otherwise(0.0)
    rows = rows.withColumns({f"_p{n}": over(n) for n in spans})
    held = {n: F.coalesce(F.lag(f"_p{n}").over(w), F.lit(0.0)) for n in spans}
    before = {n: F.coalesce(F.lag(f"_p{n}", 2).over(w), F.lit(0.0)) for n in spans}
    nets = [F.struct(F.lit(n).alias("param"), (held[n] * F.col("change") - cost * F.abs(held[n] - before[n])).alias("net")) for n in spans]
    return rows.select(by, "at", "change", F.array(*nets).alias("nets")).filter("change IS NOT NULL").select(by, "at", F.inline("nets"))


def walk_forward(grid: DataFrame, by: str, train: int, test: int, start: int = 0) -> tuple[DataFrame, DataFrame]:
    """Choices (by, step, param, sharpe) and out-of-sample rows (by, at, step, param, net) of ``grid`` (by, param, at, net).

    At each step, from ``start + train`` on and ``test`` rows apart, the parameter with the best Sharpe ratio over the rows
    from ``step - train + 1`` up to the step is used until the next one; of several the smallest. Scores are differences
    of running sums, so no step passes over its window.
    """
    walk = Window.partitionBy(by, "param").orderBy("at")
    rows = grid.withColumns({"s1": F.sum("net").over(walk), "s2": F.sum(F.col("net") * F.col("net")).over(walk), "c": F.row_number().over(walk)})
    back = lambda c: F.col(c) - F.coalesce(F.lag(c, train - 1).over(walk), F.lit(0))
    rows = rows.select(by, "param", (F.col("at") + 1).alias("step"), *[back(c).alias(c) for c in ("s1", "s2", "c")])
    rows = rows.filter((F.col("step") >= start + train) & ((F.col("step") - start - train) % test == 0))
    mean = F.col("s1") / F.col("c")
    sd = F.sqrt(F.greatest(F.col("s2") - F.col("s1") * mean, F.lit(0.0)) / (F.col("c") - 1))
    scores = rows.withColumn("sharpe", F.when((F.col("c") > 1) & (sd > 1e-12), mean / sd).otherwise(0.0))
    best = F.max(F.struct("sharpe", (-F.col("param")).alias("low"))).alias("best")
    choices = scores.groupBy(by, "step").agg(best).select(by, "step", (-F.col("best.low")).alias("param"), F.col("best.sharpe").alias("sharpe"))
    step = F.floor((F.col("at") - start - train) / test) * test + start + train
    return choices, grid.filter(F.col("at") >= start + train).withColumn("step", step).join(choices.drop("sharpe"), [by, "param", "step"])


def param_drift(choices: DataFrame, by: str) -> DataFrame:
    """Steps, mean absolute change of the chosen parameter, share of steps that change it, and its lag-1 autocorrelation."""
    rows = choices.withColumn("last", F.lag("param").over(Window.partitionBy(by).orderBy("step")))
    d = F.abs(F.col("param") - F.col("last"))
    mean = F.avg("param").over(Window.partitionBy(by))
    rows = rows.withColumn("mean", mean)
    top = F.sum((F.col("param") - F.col("mean")) * (F.col("last") - F.col("mean")))
    under = F.sum((F.col("param") - F.col("mean")) ** 2)
    n = F.greatest(F.count(F.lit(1)) - 1, F.lit(1))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("steps"), (F.coalesce(F.sum(d), F.lit(0)) / n).alias("mean_step"), (F.coalesce(F.sum((d > 0).cast("int")), F.lit(0)) / n).alias("changed"), F.when(under > 0, F.coalesce(top, F.lit(0.0)) / under).otherwise(0.0).alias("lag1"))
