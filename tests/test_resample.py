import math
import statistics

import pytest
from pyspark.sql import functions as F


def generator(seed):
    """A plain seeded generator, draw after draw."""
    state = seed
    while True:
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        v = ((state ^ (state >> 15)) * (state | 1)) & 0xFFFFFFFF
        v ^= (v + (((v ^ (v >> 7)) * (v | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        yield (v ^ (v >> 14)) / 4294967296


def quantile(values, q):
    values = sorted(values)
    at = (len(values) - 1) * q
    lo = math.floor(at)
    return values[lo] if lo == at else values[lo] * (1 - at + lo) + values[lo + 1] * (at - lo)


def summary(x):
    sd = statistics.stdev(x) if len(x) > 1 else 0.0
    mean = sum(x) / len(x)
    return mean, mean / sd if sd > 1e-12 else 0.0, math.exp(sum(math.log1p(v) for v in x)) - 1


def returns(seed, n, mean=0.0):
    draws = generator(seed)
    return [mean + (next(draws) - 0.5) / 20 for _ in range(n)]


def test_draws_are_the_generators(spark):
    from verdigris.operators import resample

    assert resample.seed_of("") == 2166136261 and resample.seed_of("a") == (2166136261 ^ 97) * 16777619 % 2**32
    seed = resample.seed_of("block-bootstrap")
    draws = generator(seed)
    want = [next(draws) for _ in range(2000)]
    got = resample.with_draw(spark.range(1, 2001), seed, F.col("id"), "u").orderBy("id").collect()
    assert [r.u for r in got] == want


@pytest.mark.parametrize("block", [None, 1, 7, 100])
def test_block_bootstrap_matches_a_loop(spark, block):
    from verdigris.operators import resample

    data = {1: returns(3, 50, 0.001), 2: returns(4, 9), 3: [0.01], 4: [0.02] * 5}
    rows = [(k, i, v) for k, x in data.items() for i, v in enumerate(x)] + [(1, -1, None)]
    got = resample.block_bootstrap(spark.createDataFrame(rows, "k int, i int, r double"), "k", "i", "r", 60, 0.9, "some seed", block).collect()
    assert {r.k for r in got} == set(data)
    for r in got:
        x, draws = data[r.k], generator(resample.seed_of("some seed"))
        size = block or max(1, math.floor(math.sqrt(len(x)) + 0.5))
        assert (r.n, r.block) == (len(x), size)
        samples = []
        for _ in range(60):
            taken = []
            while len(taken) < len(x):
                start = math.floor(next(draws) * len(x))
                taken += [x[(start + j) % len(x)] for j in range(min(size, len(x) - len(taken)))]
            samples.append(summary(taken))
        for i, c in enumerate(("mean", "sharpe", "compound")):
            assert r[c] == pytest.approx(summary(x)[i], abs=1e-9)
            if len(set(x)) > 1:
                assert r[f"{c}_lower"] == pytest.approx(quantile([s[i] for s in samples], 0.05), abs=1e-7)
                assert r[f"{c}_upper"] == pytest.approx(quantile([s[i] for s in samples], 0.95), abs=1e-7)
    assert resample.block_bootstrap(spark.createDataFrame([], "k int, i int, r double"), "k", "i", "r", 5).collect() == []


def loop_indexes(n, block, iterations, seed):
    from verdigris.operators.resample import seed_of

    test, place = generator(seed_of(seed)), generator(seed_of(f"{seed}:start"))
    for _ in range(iterations):
        now, out = None, []
        for t in range(n):
            u, v = next(test), next(place)
            now = math.floor(v * n) if t == 0 or u < 1 / block else (now + 1) % n
            out.append(now)
        yield out


@pytest.mark.parametrize("block", [1, 4, 60])
def test_predictive_ability_matches_a_loop(spark, block):
    from verdigris.operators import resample

    n, loops = 40, 50
    data = {"best": returns(1, n, 0.02), "good": returns(2, n, 0.012), "none": returns(3, n), "bad": returns(4, n, -0.03), "flat": [0.0] * n, "more": returns(5, n + 9, 0.001)}
    rows = [(k, i, v if (k, i) != ("none", 3) else None) for k, x in data.items() for i, v in enumerate(x)]
    got = {r.k: r for r in resample.predictive_ability(spark.createDataFrame(rows, "k string, i int, r double"), "k", "i", "r", loops, block, "x").collect()}
    x = {k: v[:n] for k, v in data.items()}
    x["none"][3] = 0.0
    mean, omega = {k: sum(v) / n for k, v in x.items()}, {k: statistics.stdev(v) for k, v in x.items()}
    score = {k: math.sqrt(n) * mean[k] / omega[k] if omega[k] > 1e-12 else 0.0 for k in x}
    drawn = [{k: sum(v[i] for i in at) / n for k, v in x.items()} for at in loop_indexes(n, block, loops, "x")]
    floor = -math.sqrt(2 * math.log(math.log(n)))
    real = [k for k in x if omega[k] > 1e-12]
    most = [max([0.0] + [math.sqrt(n) * (d[k] - (mean[k] if score[k] >= floor else 0)) / omega[k] for k in real]) for d in drawn]
    p = sum(m >= max(0, *score.values()) for m in most) / loops
    active, rejected = set(x), set()
    while active:
        worst = [max([math.sqrt(n) * (d[k] - mean[k]) / omega[k] for k in active if k in real], default=0.0) for d in drawn]
        new = {k for k in active if score[k] > quantile(worst, 0.95)}
        if not new:
            break
        rejected, active = rejected | new, active - new
    assert {k for k, r in got.items() if r.rejected} == rejected and "best" in rejected
    for k, r in got.items():
        assert r.p_value == pytest.approx(p) and r.studentized == pytest.approx(score[k], abs=1e-9) and r.mean == pytest.approx(mean[k], abs=1e-12)


def test_runs_go_on_as_long_as_asked(spark):
    from verdigris.operators import resample

    runs = resample.stationary_runs(spark, 500, 10, 40, "runs")
    assert runs.groupBy("resample").agg(F.sum("length").alias("n")).filter("n <> 500").count() == 0
    assert 8.5 < runs.agg(F.avg("length")).first()[0] < 11.5
