"""Seeded draws as columns, bootstrap resamples, and the tests that share them: superior predictive ability and step-down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The increment of the generator's state, its odd factors' low bits, and its shifts; the text hash's
#: start and factor. All arithmetic is modulo 2^32.
INCREMENT, ODD, SHIFTS = 0x6D2B79F5, (1, 61), (15, 7, 14)
TEXT_START, TEXT_FACTOR = 2_166_136_261, 16_777_619
LOW = (1 << 32) - 1


def seed_of(text: str) -> int:
    """The 32-bit seed that a text stands for."""
    out = TEXT_START
    for unit in memoryview(text.encode("utf-16-le")).cast("H"):
        out = ((out ^ unit) * TEXT_FACTOR) & LOW
    return out


def product(a: Column, b: Column) -> Column:
    """The product of two 32-bit numbers modulo 2^32, in halves so that no long overflows."""
    low = (a.bitwiseAND(F.lit(0xFFFF))) * b
    high = (F.shiftright(a, 16) * b).bitwiseAND(F.lit(0xFFFF))
    return (low + F.shiftleft(high, 16)).bitwiseAND(F.lit(LOW))


def with_draw(rows: DataFrame, seed: int, k: Column, name: str) -> DataFrame:
    """Add ``name``: draw number ``k`` (from 1) of the generator seeded with ``seed``, in [0, 1). The generator's state is
    the seed and a multiple of a constant, so a draw needs no other one and rows can be dealt as they like."""
    either = lambda a, b: a.bitwiseXOR(b)
    x = F.col("_draw")
    rows = rows.withColumn("_draw", (F.lit(seed) + product(F.lit(INCREMENT).cast("long"), k.cast("long").bitwiseAND(F.lit(LOW)))).bitwiseAND(F.lit(LOW)))
    rows = rows.withColumn("_draw", product(either(x, F.shiftright(x, SHIFTS[0])), x.bitwiseOR(F.lit(ODD[0]))))
    step = product(either(x, F.shiftright(x, SHIFTS[1])), x.bitwiseOR(F.lit(ODD[1])))
    rows = rows.withColumn("_draw", either(x, (x + step).bitwiseAND(F.lit(LOW))))
    return rows.withColumn(name, either(x, F.shiftright(x, SHIFTS[2])) / F.lit(float(1 << 32))).drop("_draw")


def block_bootstrap(series: DataFrame, by: str, order: str, r: str, iterations: int = 1000, level: float = 0.95, seed: str = "block-bootstrap", block: int | None = None) -> DataFrame:
    """``by``, n, block, and for mean, sharpe and compound change the estimate with the bounds of its circular-block
    bootstrap interval at ``level``.

    A resample is as many whole blocks from random starts as cover the rows, the last one cut; a block has about the root of
    n rows. A block's sums come from running sums over the series, so a resample is a sum over its blocks: rows are
    dealt by (series, resample, block), looked up by start, and combined map-side. Null changes are left out.
    """
    rows = series.filter(F.col(r).isNotNull()).select(by, F.col(order).alias("_o"), F.col(r).cast("double").alias("x"))
    walk = Window.partitionBy(by).orderBy("_o")
    rows = rows.withColumn("at", F.row_number().over(walk) - 1)
    sums = {"s1": F.col("x"), "s2": F.col("x") * F.col("x"), "sl": F.ln(1 + F.col("x"))}
    upto = rows.select(by, "at", *[F.sum(v).over(walk).alias(c) for c, v in sums.items()])
    whole = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"{c}_all") for c, v in sums.items()])
    size = F.greatest(F.lit(1), F.round(F.sqrt("n")).cast("long")) if block is None else F.lit(block).cast("long")
    whole = whole.withColumn("block", size).withColumn("blocks", F.ceil(F.col("n") / F.col("block")))
    draws = whole.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    draws = with_draw(draws, seed_of(seed), F.col("resample") * F.col("blocks") + F.col("part") + 1, "u")
    draws = draws.withColumn("start", F.floor(F.col("u") * F.col("n"))).withColumn("length", F.least("block", F.col("n") - F.col("part") * F.col("block")))
    # a block that runs past the end goes on at the start: from one running sum to another, and whole turns
    end = F.col("start") + F.col("length") - 1
    ends = [(F.col("start") - 1, F.lit(-1)), (end % F.col("n"), F.lit(1)), (F.col("n") - 1, F.floor(end / F.col("n")))]
    drawn = draws.select(by, "resample", "n", F.inline(F.array(*[F.struct(at.cast("long").alias("at"), sign.cast("double").alias("sign")) for at, sign in ends])))
    found = drawn.filter("at >= 0 AND sign <> 0").join(upto, [by, "at"])
    each = found.groupBy(by, "resample", "n").agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in sums])
    each = each.select(by, *statistics("n", "s1", "s2", "sl"))
    tail = (1 - level) / 2
    bounds = each.groupBy(by).agg(*[F.percentile(c, F.lit(q)).alias(f"{c}_{side}") for c in STATISTICS for side, q in (("lower", tail), ("upper", 1 - tail))])
    return whole.select(by, "n", "block", *statistics("n", "s1_all", "s2_all", "sl_all")).join(bounds, by)


STATISTICS = ("mean", "sharpe", "compound")


def statistics(n: str, s1: str, s2: str, sl: str) -> list[Column]:
    """Mean, mean over deviation (n - 1; 0 if flat), and compound change, from a count and three sums."""
    mean = F.col(s1) / F.col(n)
    sd = F.sqrt(F.greatest(F.col(s2) - F.col(s1) * mean, F.lit(0.0)) / F.greatest(F.col(n) - 1, F.lit(1)))
    return [mean.alias("mean"), F.when(sd > 1e-12, mean / sd).otherwise(0.0).alias("sharpe"), (F.exp(sl) - 1).alias("compound")]


def stationary_runs(spark, n: int, block: int, iterations: int, seed: str) -> DataFrame:
    """(resample, start, length): the runs of stationary bootstrap resamples of ``n`` places. A run goes on with
    probability 1 - 1 / ``block`` at each step and wraps at the end; a new one starts anywhere. Whether a step starts a run and
    where are draws of their own number, so no step waits for the one before."""
    steps = spark.range(iterations * n).select(F.floor(F.col("id") / n).alias("resample"), (F.col("id") % n).alias("t"), "id")
    steps = with_draw(steps, seed_of(seed), F.col("id") + 1, "u").filter((F.col("t") == 0) | (F.col("u") < 1.0 / max(1, block)))
    steps = with_draw(steps, seed_of(f"{seed}:start"), F.col("id") + 1, "v")
    after = F.lead("t").over(Window.partitionBy("resample").orderBy("t"))
    return steps.select("resample", F.floor(F.col("v") * n).alias("start"), (F.coalesce(after, F.lit(n)) - F.col("t")).alias("length"))


def resampled_means(rows: DataFrame, by: str, n: int, runs: DataFrame) -> DataFrame:
    """(by, resample, mean) of every strategy of ``rows`` (by, at, x) under the same ``runs``, from running sums: a run
    meets each strategy at its two ends and not at each place."""
    upto = rows.select(by, "at", F.sum("x").over(Window.partitionBy(by).orderBy("at")).alias("s"))
    end = F.col("start") + F.col("length") - 1
    ends = [(F.col("start") - 1, F.lit(-1)), (end % n, F.lit(1)), (F.lit(n - 1), F.floor(end / n))]
    ends = runs.select("resample", F.inline(F.array(*[F.struct(at.cast("long").alias("at"), sign.cast("double").alias("sign")) for at, sign in ends])))
    # the last place stays even with a sign of 0, so that every resample is there
    ends = ends.groupBy("resample", "at").agg(F.sum("sign").alias("sign")).filter((F.col("at") == n - 1) | (F.col("at") >= 0) & (F.col("sign") != 0))
    return ends.join(upto, "at").groupBy(by, "resample").agg((F.sum(F.col("s") * F.col("sign")) / n).alias("mean"))


def predictive_ability(rows: DataFrame, by: str, order: str, x: str, iterations: int = 1000, block: int | None = None, seed: str = "spa", alpha: float = 0.05) -> DataFrame:
    """Superior predictive ability and step-down rejection of all strategies of ``rows`` under shared stationary resamples.

    by, mean, studentized (root of n times mean over deviation, 0 if flat), p_value (share of resamples whose largest
    recentred studentized mean reaches the best strategy's), critical and rejected. Strategies have the first n values
    each, n being the fewest that any has; null counts as 0. A mean far below zero (by the law of the iterated logarithm)
    is left uncentred. In step-down, a strategy is judged against resamples' maxima over those not better than itself;
    as these only fall, it is rejected if it and all better ones are over theirs. One row a strategy: windows over
    strategies hold as many rows as there are.
    """
    spark = rows.sparkSession
    place = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    rows = rows.select(by, place.cast("long").alias("at"), F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias("x"))
    n = rows.groupBy(by).count().agg(F.min("count")).first()[0] or 0
    rows = rows.filter(F.col("at") < n)
    stats = rows.groupBy(by).agg(F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("omega"))
    stats = stats.withColumn("studentized", F.when(F.col("omega") > 1e-12, F.sqrt(F.lit(float(n))) * F.col("mean") / F.col("omega")).otherwise(0.0))
    if n < 2:
        return stats.select(by, "mean", "studentized", F.lit(1.0).alias("p_value"), F.lit(None).cast("double").alias("critical"), F.lit(False).alias("rejected"))
    order = Window.orderBy(F.desc("studentized"), by)
    stats = stats.withColumn("place", F.row_number().over(order))
    runs = stationary_runs(spark, n, block or max(1, int(n**0.5 + 0.5)), iterations, seed)
    drawn = resampled_means(rows, by, n, runs).withColumnRenamed("mean", "drawn").join(stats.filter("omega > 1e-12"), by)
    scale = F.sqrt(F.lit(float(n))) / F.col("omega")
    kept = F.when(F.col("studentized") >= -F.sqrt(2 * F.ln(F.ln(F.lit(float(n))))), F.col("mean")).otherwise(0.0)
    drawn = drawn.select("resample", "place", ((F.col("drawn") - kept) * scale).alias("recentred"), ((F.col("drawn") - F.col("mean")) * scale).alias("centred"))
    best = F.greatest(F.max("studentized").over(Window.partitionBy()), F.lit(0.0))
    reached = drawn.groupBy("resample").agg(F.greatest(F.max("recentred"), F.lit(0.0)).alias("most"))
    worse = Window.partitionBy("resample").orderBy(F.desc("place"))
    critical = drawn.withColumn("most", F.max("centred").over(worse)).groupBy("place").agg(F.percentile("most", F.lit(1 - alpha)).alias("critical"))
    out = stats.withColumn("best", best).join(critical, "place", "left")
    exceed = reached.join(out.select("best").limit(1), F.lit(True)).agg((F.sum((F.col("most") >= F.col("best")).cast("int")) / iterations).alias("p_value"))
    over = F.coalesce(F.col("studentized") > F.col("critical"), F.lit(False))
    out = out.withColumn("rejected", F.min(over.cast("int")).over(Window.orderBy("place")) == 1)
    return out.join(exceed, F.lit(True)).select(by, "mean", "studentized", "p_value", "critical", "rejected")
