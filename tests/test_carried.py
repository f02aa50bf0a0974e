import math
import random

import pytest
from pyspark.sql import functions as F


@pytest.fixture(params=[3, 10_000])
def chunked(spark, request):
    """Arrow batches of two sizes: what a state carries from one to the next may not matter."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield spark
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def walk(seed, n):
    rng, v, out = random.Random(seed), 100.0, []
    for _ in range(n):
        v *= 1 + rng.uniform(-0.06, 0.06)
        out.append(v)
    return out


def loop_supertrend(bars, n, mult, both, confirm):
    out, atr, last, up, down, rising, mean, warm = [], None, None, None, None, True, None, 0
    for bar in bars:
        if bar is None:
            out.append(None)
            continue
        high, low, close = bar
        tr = high - low if last is None else max(high - low, abs(high - last), abs(low - last))
        atr = tr if atr is None else (atr * (n - 1) + tr) / n
        mean = close if mean is None else mean + (close - mean) * 2 / (confirm + 1)
        a, b = (high + low) / 2 + mult * atr, (high + low) / 2 - mult * atr
        if up is None:
            up, down = a, b
        else:
            if a < up or last > up:
                up = a
            if b > down or last < down:
                down = b
        if rising and close < down:
            rising = False
        elif not rising and close > up:
            rising = True
        warm, last = warm + 1, close
        s = 0 if warm <= n + 1 else 1 if rising else -1 if both else 0
        if confirm and (s > 0 and close < mean or s < 0 and close > mean):
            s = 0
        out.append(s)
    return out


@pytest.mark.parametrize("both, confirm", [(True, 0), (False, 0), (True, 5)])
def test_supertrend(chunked, both, confirm):
    from verdigris.operators import carried

    data = {}
    for k in (1, 2, None):
        x = walk(k or 9, 60)
        data[k] = [None if i % 17 == 5 else (v * 1.02, v * 0.97, v) for i, v in enumerate(x)]
    rows = [(k, i, *(bar or (None, None, None))) for k, bars in data.items() for i, bar in enumerate(bars)]
    df = chunked.createDataFrame(rows, "k int, i int, high double, low double, close double").repartition(5)
    got = {(r.k, r.i): r.position for r in carried.supertrend(df, "k", "i", 4, 1.5, both, confirm).collect()}
    for k, bars in data.items():
        assert [got[k, i] for i in range(60)] == loop_supertrend(bars, 4, 1.5, both, confirm)
    assert {1, -1 if both else 0} <= set(got.values())


def test_renko(chunked):
    from verdigris.operators import carried

    rows, want = [], {}
    for k in (1, 2):
        anchor, side = None, 0
        for i, v in enumerate(walk(k, 80)):
            v, size = (None, 4.0) if i == 7 else (v, None if i == 9 else 4.0)
            rows.append((k, i, v, size))
            bricks = 0
            if v is not None and size is not None:
                if anchor is None:
                    anchor = v
                else:
                    up, down = math.floor((v - anchor) / size), math.floor((anchor - v) / size)
                    if up >= (2 if side < 0 else 1):
                        bricks = up
                    elif down >= (1 if side < 0 else 2):
                        bricks = -down
                    anchor += bricks * size
                    side = side if bricks == 0 else int(math.copysign(1, bricks))
            want[k, i] = (side, bricks)
    df = chunked.createDataFrame(rows, "k int, i int, v double, size double")
    got = {(r.k, r.i): (r.direction, r.bricks) for r in carried.renko(df, "k", "i", "v", "size", 2).collect()}
    assert got == want and {s for s, _ in want.values()} == {0, 1, -1}


def test_banding(chunked):
    from verdigris.operators import carried

    rng = random.Random(2)
    targets = [[rng.choice([0.0, 0.0, 0.3, 0.5, -0.2, -0.7]) if t % 6 else 0.0 for _ in range(4)] for t in range(40)]
    prev, want = [0.0] * 4, {}
    for t, cur in enumerate(targets):
        if any(cur):
            prev = [p if p * c > 0 else c for p, c in zip(prev, cur)]
        want.update({(s, t): prev[s] for s in range(4)})
    rows = [(s, t, targets[t][s] or None if t % 2 else targets[t][s]) for s in range(4) for t in range(40)]
    got = {(r.s, r.t): r.held for r in carried.banded(chunked.createDataFrame(rows, "s int, t int, x double"), "s", "t", "x").collect()}
    assert got == want


@pytest.mark.parametrize("leave", [None, -0.001])
def test_funding_carry(chunked, leave):
    from verdigris.operators import carried

    rng, rows, want = random.Random(4), [], {}
    for k, n in ((1, 50), (2, 1), (3, 30)):
        held, net, gross, fees, entries, trued, inside, netlog, last = False, [], 0.0, 0.0, 0, 0, 0, 0.0, 0.0
        for i in range(n):
            rate, basis = rng.uniform(-0.002, 0.003), rng.uniform(-0.02, 0.02)
            rate = None if i == 11 else rate
            rows.append((k, i, rate, basis))
            rate = rate or 0.0
            pnl = fee = 0.0
            if not held:
                if rate > 0.0005:
                    held, entries, fee, pnl, inside = True, entries + 1, 0.0008, rate, inside + 1
            else:
                pnl, inside = rate, inside + 1
                if abs(basis) > 0.01:
                    fee, trued = fee + 0.0004, trued + 1
                if rate <= (0.0005 if leave is None else leave):
                    fee, held = fee + 0.0008, False
            fees += fee
            gross += math.log1p(pnl)
            netlog += math.log1p(pnl - fee)
            net.append(pnl - fee)
        if held:
            fees += 0.0008
            netlog += math.log1p(-0.0008)
            net[-1] -= 0.0008
        want[k] = (n, inside, entries, trued, fees, math.expm1(gross), math.expm1(netlog), math.expm1(gross / inside * carried.SETTLEMENTS) if inside else 0.0, math.expm1(netlog / n * carried.SETTLEMENTS), sum(net) / n)
    steps = carried.funding_carry(chunked.createDataFrame(rows, "k int, i int, r double, b double"), "k", "i", "r", "b", 0.0005, leave)
    got = {r[0]: tuple(r)[1:] for r in carried.carry_summary(steps, "k").collect()}
    for k, x in want.items():
        assert got[k] == pytest.approx(x, rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("most", [1, 6])
def test_bracket_trades(chunked, most):
    from verdigris.operators import carried

    data, want = {1: walk(1, 70), 2: walk(2, 2), 3: [5.0], 4: [0.0, 1.0, 2.0, 4.0]}, set()
    for k, path in data.items():
        i = 0
        while i < len(path) - 1:
            for j in range(i + 1, min(len(path) - 1, i + most) + 1):
                change = path[j] / path[i] - 1 if path[i] else 0.0
                reason = "takeProfit" if change >= 0.07 else "stopLoss" if change <= -0.05 else "time" if j == min(len(path) - 1, i + most) else None
                if reason:
                    want.add((k, i, j, change, reason))
                    break
            i = j + 1
    df = chunked.createDataFrame([(k, i, v) for k, x in data.items() for i, v in enumerate(x)], "k int, i int, v double").repartition(4)
    trades = carried.bracket_trades(df, "k", "i", "v", 0.07, 0.05, most)
    assert {tuple(r) for r in trades.collect()} == want
    sums = {r.k: r for r in carried.bracket_outcomes(trades, "k").collect()}
    assert sums[1].trades == sum(w[0] == 1 for w in want) == sums[1].taken + sums[1].stopped + sums[1].timed
    assert carried.bracket_trades(df.limit(0), "k", "i", "v", 0.07, 0.05, most).collect() == []


def test_bias_is_that_of_complete_buckets(spark):
    from verdigris.operators import walkforward

    r = [0.1, 0.2, -0.5, 0.1, None, 0.0, 9.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(r)], "k int, i int, r double")
    got = walkforward.higher_bias(df, "k", "i", "r", 2).orderBy("i").collect()
    assert [x.bias for x in got] == ["flat", "flat", "up", "up", "down", "down", "flat"]
    # what comes later changes nothing before it
    again = walkforward.higher_bias(df.withColumn("r", F.when(F.col("i") >= 5, 7.0).otherwise(F.col("r"))), "k", "i", "r", 2).orderBy("i").collect()
    assert [x.bias for x in again][:6] == [x.bias for x in got][:6]
    sides = spark.createDataFrame([("up", 1.0), ("up", -1.0), ("down", -2.0), ("flat", 1.0), (None, 1.0), ("up", 0.0)], "bias string, p double")
    assert [x.gated for x in walkforward.bias_gate(sides, "p", "bias").collect()] == [1.0, 0.0, -2.0, 1.0, 1.0, 0.0]
    assert [x.gated for x in walkforward.bias_gate(sides, "p", "bias", True).collect()] == [1.0, 0.0, -2.0, 0.0, 0.0, 0.0]


def test_walk_forward_matches_a_loop(spark):
    from statistics import mean, stdev

    from verdigris.operators import walkforward

    rng = random.Random(8)
    grid = {p: [rng.gauss(0.001 * p, 0.02) for _ in range(90)] for p in (1, 2, 3)}
    df = spark.createDataFrame([("s", p, i, v) for p, x in grid.items() for i, v in enumerate(x)], "k string, param int, at long, net double")
    choices, rows = walkforward.walk_forward(df, "k", 20, 15, start=5)
    want = []
    for step in range(25, 91, 15):
        scores = {p: mean(x[step - 19 : step]) / stdev(x[step - 19 : step]) for p, x in grid.items()}
        want.append((step, max(scores, key=lambda p: (scores[p], -p))))
    assert [(r.step, r.param) for r in choices.orderBy("step").collect()] == want
    used = {r.at: (r.param, r.net) for r in rows.collect()}
    assert used == {i: (p, grid[p][i]) for step, p in want for i in range(step, min(step + 15, 90))}
