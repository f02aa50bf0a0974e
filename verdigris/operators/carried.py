"""Recurrences over ordered series: sorted Arrow batches with a small state that is carried from one to the next."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Funding settlements in a year, three a day.
SETTLEMENTS = 365.25 * 3


def carried(rows: DataFrame, by: str, order: str, inputs: Sequence[str], outputs: str, machine: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """``by``, ``order`` and ``outputs`` (a schema) of every row: what a fresh ``machine()`` for each series returns when it is
    called with ``inputs`` row after row. Rows go to tasks by series and come sorted; a task holds one batch and one state,
    so memory does not grow with a series, and batch sizes change nothing. Null series are one series."""
    kinds = dict(rows.dtypes)
    schema = f"{by} {kinds[by]}, {order} {kinds[order]}, {outputs}"
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for batch in batches:
            out = []
            for key, *values in zip(batch.column(0).to_pylist(), *[c.to_pylist() for c in batch.columns[2:]]):
                if step is None or key != now:
                    now, step = key, machine()
                out.append(step(*values))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array([r[i] for r in out], k) for i, k in enumerate(arrow)]], names=names)

    arrow = [{"double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[part.split()[1]] for part in outputs.split(", ")]
    return rows.select(by, order, *inputs).repartition(by).sortWithinPartitions(by, order).mapInArrow(run, schema)


def supertrend(bars: DataFrame, by: str, order: str, n: int = 10, mult: float = 3.0, both: bool = True, confirm: int = 0) -> DataFrame:
    """position by bands of ``mult`` mean true ranges (Wilder's, ``n``) around the middle: 1 in an up trend, in a down trend
    -1 or, without ``both``, 0; 0 for the first ``n`` + 1 bars, and where a close is on the wrong side of its exponential
    mean over ``confirm`` bars, if asked. A bar with a null leaves the state as it is and has no position."""

    def machine():
        atr = last = upper = lower = mean = None
        up, seen = True, 0

        def step(high, low, close):
            nonlocal atr, last, upper, lower, mean, up, seen
            if high is None or low is None or close is None:
                return (None,)
            reach = high - low if last is None else max(high - low, abs(high - last), abs(low - last))
            atr = reach if atr is None else (atr * (n - 1) + reach) / n
            if confirm > 0:
                mean = close if mean is None else mean + 2 / (confirm + 1) * (close - mean)
            top, bottom = (high + low) / 2 + mult * atr, (high + low) / 2 - mult * atr
            upper = top if upper is None or top < upper or last > upper else upper
            lower = bottom if lower is None or bottom > lower or last < lower else lower
            up = close >= lower if up else close > upper
            seen, last = seen + 1, close
            if seen <= n + 1:
                return (0,)
            side = 1 if up else -1 if both else 0
            if confirm > 0 and (side > 0 and close < mean or side < 0 and close > mean):
                side = 0
            return (side,)

        return step

    return carried(bars, by, order, ["high", "low", "close"], "position int", machine)


def renko(series: DataFrame, by: str, order: str, v: str, brick: str, reversal: int = 1) -> DataFrame:
    """direction of the last brick at each row's close (0: none yet), and bricks, how many of ``brick`` the row adds: one goes on
    with a trend, ``reversal`` of them turn it. Rows without a value or a positive size change nothing."""

    def machine():
        anchor, side = None, 0

        def step(value, size):
            nonlocal anchor, side
            if value is None or not math.isfinite(value) or not (size or 0) > 0:
                return side, 0
            if anchor is None:
                anchor = value
                return 0, 0
            up, down = math.floor((value - anchor) / size), math.floor((anchor - value) / size)
            bricks = up if up >= (1 if side >= 0 else reversal) else -down if down >= (1 if side < 0 else reversal) else 0
            anchor += bricks * size
            side = side if not bricks else 1 if bricks > 0 else -1
            return side, bricks

        return step

    return carried(series, by, order, [v, brick], "direction int, bricks int", machine)


def banded(panel: DataFrame, by: str, at: str, target: str) -> DataFrame:
    """held: a target is taken up when its sign changes, and else the held one stays; at a time at which no series has a
    target all keep what they hold. Null counts as no target."""
    sign = F.coalesce(F.col(target), F.lit(0.0))
    times = panel.groupBy(F.col(at).alias("_at")).agg(F.max((sign != 0).cast("int")).alias("any"))
    rows = panel.select(by, at, sign.alias("target")).join(times, F.col(at).eqNullSafe(F.col("_at"))).drop("_at")

    def machine():
        held = 0.0

        def step(value, some):
            nonlocal held
            if some and not (held and held * value > 0):
                held = value
            return (held,)

        return step

    return carried(rows, by, at, ["target", "any"], "held double", machine)


def funding_carry(rates: DataFrame, by: str, order: str, rate: str, basis: str | None = None, entry: float = 0.0, leave: float | None = None, fee: float = 0.0004, drift: float = 0.01) -> DataFrame:
    """entered, in_position, rebalanced, funding, fee, unwind and net of every settlement of a hedged carry: opened (two legs' fees)
    when the rate is over ``entry``, collected while it lasts, trued up (one fee) when the basis moves by over ``drift``, and
    closed (two) when the rate is at ``leave`` (``entry`` if none) or under, or after the last settlement (``unwind``, within
    ``fee``). A null rate is 0."""
    leave = entry if leave is None else leave
    last = F.lead(order).over(Window.partitionBy(by).orderBy(order)).isNull()
    moves = F.lit(0.0) if basis is None else F.coalesce(F.abs(basis), F.lit(0.0))
    rows = rates.select(by, order, F.coalesce(rate, F.lit(0.0)).alias("_rate"), moves.alias("_basis"), last.alias("_last"))

    def machine():
        held = False

        def step(value, move, is_last):
            nonlocal held
            entered = not held and value > entry
            if not held and not entered:
                return False, False, False, 0.0, 0.0, 0.0, 0.0
            cost, trued = 2 * fee * entered, held and move > drift
            cost += fee * trued
            stays = entered or value > leave
            unwind = 2 * fee * (stays and is_last)
            cost += 2 * fee * (not stays) + unwind
            held = stays
            return entered, True, trued, value, cost, unwind, value - cost

        return step

    return carried(rows, by, order, ["_rate", "_basis", "_last"], "entered boolean, in_position boolean, rebalanced boolean, funding double, fee double, unwind double, net double", machine)


def carry_summary(settlements: DataFrame, by: str, year: float = SETTLEMENTS) -> DataFrame:
    """Counts, fees, compounded gross and net yields and their annual rates of ``funding_carry``'s rows, by series."""
    log = lambda c: F.log1p(F.greatest(c, F.lit(-1 + 1e-12)))
    sums = settlements.groupBy(by).agg(
        F.count(F.lit(1)).alias("intervals"), F.sum(F.col("in_position").cast("int")).alias("held"), F.sum(F.col("entered").cast("int")).alias("entries"), F.sum(F.col("rebalanced").cast("int")).alias("rebalances"),
        F.sum("fee").alias("fees"), F.sum(log(F.col("funding"))).alias("gross_log"), F.sum(log(F.col("net") + F.col("unwind")) + log(-F.col("unwind"))).alias("net_log"), F.avg("net").alias("mean_net"),
    )
    apr = lambda c, n: F.when(F.col(n) > 0, F.expm1(F.col(c) / F.col(n) * year)).otherwise(0.0)
    return sums.select(by, "intervals", "held", "entries", "rebalances", "fees", F.expm1("gross_log").alias("gross_yield"), F.expm1("net_log").alias("net_yield"), apr("gross_log", "held").alias("gross_apr"), apr("net_log", "intervals").alias("net_apr"), "mean_net")


def bracket_trades(path: DataFrame, by: str, order: str, v: str, take: float, stop: float, most: int) -> DataFrame:
    """The trades of a bracket along each path, one at a time: entry and exit row (from 0), pnl and reason. A trade is entered
    on the row after the last exit and closed on the first row on which its return is ``take`` or more, ``-stop`` or less
    (both at once: take), or that is ``most`` rows on or the last one; none is entered on the last row."""
    most = max(1, int(most))
    last = F.lead(order).over(Window.partitionBy(by).orderBy(order)).isNull()
    rows = path.select(by, order, F.col(v).cast("double").alias("_v"), last.alias("_last"))

    def machine():
        place, start, price = -1, None, 0.0

        def step(value, is_last):
            nonlocal place, start, price
            place += 1
            if start is None:
                start, price = (None, 0.0) if is_last else (place, value)
                return None, None, None, None
            change = value / price - 1 if price else 0.0
            reason = "takeProfit" if change >= take else "stopLoss" if change <= -stop else "time" if is_last or place - start >= most else None
            if reason is None:
                return None, None, None, None
            entry, start = start, None
            return entry, place, change, reason

        return step

    trades = carried(rows, by, order, ["_v", "_last"], "entry long, exit long, pnl double, reason string", machine)
    return trades.filter("exit IS NOT NULL").drop(order)


def bracket_outcomes(trades: DataFrame, by: str) -> DataFrame:
    """Trades, those of each reason, the share that won and the sum of their returns, by series."""
    count = lambda c: F.sum(c.cast("long"))
    reason = F.col("reason")
    return trades.groupBy(by).agg(F.count(F.lit(1)).alias("trades"), *[count(reason == r).alias(n) for r, n in (("takeProfit", "taken"), ("stopLoss", "stopped"), ("time", "timed"))], F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.sum("pnl").alias("total"))
