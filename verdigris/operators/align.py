"""As-of alignment, grids and lagged pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_last(probes: DataFrame, events: DataFrame, by: str, at: str, ts: str, tie: str, value: str) -> DataFrame:
    """Each probe (by, at) with the last event of its group at or before it: one union and one window, so the shuffle
    is the two inputs once and no pair is formed."""
    left = probes.select(by, F.col(at).alias("_t"), F.lit(1).alias("_probe"), F.lit(None).cast("long").alias("_tie"), F.lit(None).cast(events.schema[value].dataType).alias("_v"), F.lit(None).cast("timestamp").alias("_at"))
    right = events.select(by, F.col(ts).alias("_t"), F.lit(0).alias("_probe"), F.col(tie).cast("long").alias("_tie"), F.col(value).alias("_v"), F.col(ts).cast("timestamp").alias("_at"))
    w = Window.partitionBy(by).orderBy("_t", "_probe", "_tie")
    last = F.last(F.when(F.col("_probe") == 0, F.struct("_v", "_at")), ignorenulls=True).over(w)
    rows = left.unionByName(right).withColumn("_last", last).filter("_probe = 1")
    return rows.select(by, F.col("_t").alias(at), F.col("_last._v").alias(value), F.col("_last._at").alias(ts))


def fill_grid(panel: DataFrame, by: str = "series_id", at: str = "week", v: str = "v") -> DataFrame:
    """Every series at every period that any has, from its first on, with the last value carried forward. The periods
    are exploded from each series' own first one rather than joined crosswise."""
    grid = panel.groupBy(by).agg(F.min(at).alias("first"))
    last = panel.agg(F.max(at).alias("last"))
    step = F.expr("INTERVAL 7 DAYS")
    points = grid.join(F.broadcast(last), F.lit(True)).select(by, F.explode(F.sequence("first", "last", step)).alias(at))
    w = Window.partitionBy(by).orderBy(at)
    return points.join(panel, [by, at], "left").withColumn("filled", F.last(v, ignorenulls=True).over(w))


def lagged_correlations(a: DataFrame, b: DataFrame, lags: range, by: str = "series_id", at: str = "week", x: str = "x") -> DataFrame:
    """Correlation of the one series ``a`` (at, x) with each of ``b`` (by, at, x), ``lag`` periods of seven days later."""
    shifted = b.select(by, F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"), at, F.col(x).alias("y"))
    shifted = shifted.withColumn(at, F.date_sub(at, F.col("lag") * 7))
    rows = shifted.join(a.select(at, x), at)
    return rows.groupBy(by, "lag").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 3, F.corr(x, "y")).alias("corr"))


def asof_next(left: DataFrame, right: DataFrame, by: str, at: str, tie: str, value: str) -> DataFrame:
    """``tie`` of each left row with the first right row of its ``by`` at its time or later: next_id and next_value, null
    if there is none; of several at one time that with the smallest ``tie``.

    Both sides are one stream in order of time, so no pair is made: a window carries the next right row back.
    """
    mark = F.struct(F.col(tie).alias("id"), F.col(value).alias("value"))
    both = left.select(by, at, F.lit(0).alias("side"), F.col(tie).alias("own"), F.lit(None).cast(right.select(mark.alias("m")).schema["m"].dataType).alias("mark"))
    both = both.unionByName(right.select(by, at, F.lit(1).alias("side"), F.col(tie).alias("own"), mark.alias("mark")))
    w = Window.partitionBy(by).orderBy(at, "side", "own").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = both.withColumn("next", F.first("mark", ignorenulls=True).over(w)).filter("side = 0")
    return rows.select(F.col("own").alias(tie), F.col("next.id").alias("next_id"), F.col("next.value").alias("next_value"))
