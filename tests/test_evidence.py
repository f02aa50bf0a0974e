"""Purged paths, odds of overfitting, haircut Sharpe ratios and pairs against plain loops; their queries against SQL."""

import math
import random
from itertools import combinations
from statistics import NormalDist, mean, median, stdev

import numpy as np
import pytest
from pyspark.sql import functions as F

from .test_queries import DATA, duck, plain  # noqa: F401


@pytest.mark.parametrize("name", ["cpcv_paths", "cpcv_scores", "overfitting_odds", "haircut_sharpes", "pair_stationarity"])
def test_query_matches_sql(spark, duck, name):  # noqa: F811
    from verdigris.plans import evidence  # noqa: F401
    from verdigris.plans.queries import QUERIES, SQL

    df, want = QUERIES[name](spark, DATA), duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted("|".join(map(plain, r)) for r in df.select(*columns).collect())
    assert got == sorted("|".join(plain(r[i]) for i in at) for r in want.fetchall()) and got


def ratio(xs):
    return mean(xs) / stdev(xs) if len(xs) > 1 and stdev(xs) > 1e-12 else 0.0


def loop_paths(grid, folds, held, purge, embargo):
    """{path: returns} of one series' grid {param: returns}, fold after fold."""
    n = len(next(iter(grid.values())))
    fold = [t * folds // n for t in range(n)]
    used, out = [0] * folds, {}
    for test in combinations(range(folds), held):
        banned = set()
        for f in test:
            at = [t for t in range(n) if fold[t] == f]
            if at:
                banned |= set(range(at[0] - purge, at[-1] + 1 + purge + embargo))
        seen = [t for t in range(n) if t not in banned]
        best = min(grid, key=lambda p: (-round(ratio([grid[p][t] for t in seen]), 9), p))
        for f in test:
            out.setdefault(used[f], []).extend(grid[best][t] for t in range(n) if fold[t] == f)
            used[f] += 1
    return out


@pytest.mark.parametrize("n, folds, held, purge, embargo", [(97, 6, 2, 1, 5), (60, 5, 2, 2, 0), (64, 4, 1, 0, 3), (120, 6, 3, 3, 4)])
def test_paths_equal_the_loop(spark, n, folds, held, purge, embargo):
    from verdigris.operators.purged import cpcv_paths, path_scores

    rng = random.Random(n)
    grids = {s: {p: [rng.gauss(0.001 * p, 0.02) for _ in range(n)] for p in (5, 10, 20)} for s in ("x", "y")}
    rows = [(s, p, t + 3, v) for s, g in grids.items() for p, vs in g.items() for t, v in enumerate(vs)]
    paths = cpcv_paths(spark.createDataFrame(rows, "s string, param int, at long, net double"), "s", folds, held, purge, embargo)
    got = {(r.s, r.path): r for r in paths.collect()}
    scores = {r.s: r for r in path_scores(paths, "s").collect()}
    for s, g in grids.items():
        want = loop_paths(g, folds, held, purge, embargo)
        assert {k[1] for k in got if k[0] == s} == set(want) == set(range(math.comb(folds - 1, held - 1)))
        for path, xs in want.items():
            r = got[s, path]
            assert (r.n, r.sharpe, r.total) == (len(xs), pytest.approx(ratio(xs)), pytest.approx(math.prod(1 + v for v in xs) - 1)) and r.n == n
        sharpes, totals = [ratio(xs) for xs in want.values()], [math.prod(1 + v for v in xs) - 1 for xs in want.values()]
        spread, share = stdev(sharpes) if len(sharpes) > 1 else 0, sum(t > 0 for t in totals) / len(totals)
        assert scores[s].score == pytest.approx(0.55 * median(sharpes) + 0.45 * min(sharpes) - 0.5 * spread + 0.3 * share)
        every = np.array([v for xs in want.values() for v in xs])
        assert scores[s].skew == pytest.approx(np.mean((every - every.mean()) ** 3) / every.std(ddof=1) ** 3, abs=1e-6)


def test_paths_of_ruin_ties_and_nothing(spark):
    from verdigris.operators.purged import cpcv_paths, path_scores

    schema = "s string, param int, at long, net double"
    rows = [("ruin", p, t, -1.0 if t == 7 else 0.01) for p in (1, 2) for t in range(24)] + [(None, 1, t, 0.01) for t in range(24)]
    paths = cpcv_paths(spark.createDataFrame(rows, schema), "s")
    assert {r.total for r in paths.filter("s = 'ruin'").collect()} == {-1.0}
    # a null key joins nothing
    assert paths.filter("s IS NULL").count() == 0
    assert path_scores(paths, "s").first().positive == 0
    assert cpcv_paths(spark.createDataFrame([], schema), "s").count() == 0


def loop_odds(gains, folds, share):
    size = max(1, min(folds - 1, math.floor(folds * share + 0.5)))
    logits = []
    for train in combinations(range(folds), size):
        part = lambda s, inside: round(sum(gains[s].get(f, 0.0) for f in range(folds) if (f in train) == inside), 9)
        best = min(gains, key=lambda s: (-part(s, True), s))
        place = sorted(gains, key=lambda s: (-part(s, False), s)).index(best)
        q = 0.5 if len(gains) == 1 else 1 - place / (len(gains) - 1)
        q = min(max(q, 1e-12), 1 - 1e-12)
        logits.append(math.log(q / (1 - q)))
    return len(gains), len(logits), sum(v < 0 for v in logits) / len(logits), mean(logits), median(logits)


@pytest.mark.parametrize("folds, share, m", [(5, 0.5, 7), (6, 0.3, 4), (2, 0.5, 2), (4, 0.9, 1)])
def test_odds_equal_the_loop(spark, folds, share, m):
    from verdigris.operators.purged import overfit_odds

    rng = random.Random(folds)
    gains = {f"s{i}": {f: rng.choice([-0.1, 0.0, 0.1, rng.random()]) for f in range(folds) if f or i} for i in range(m)}
    rows = [(s, f, g) for s, fs in gains.items() for f, g in fs.items()]
    r = overfit_odds(spark.createDataFrame(rows, "s string, f int, g double"), "s", "f", "g", folds, share).first()
    want = loop_odds(gains, folds, share)
    assert (r.strategies, r.splits, r.pbo) == (want[0], want[1], pytest.approx(want[2]))
    assert (r.mean_logit, r.median_logit) == (pytest.approx(want[3]), pytest.approx(want[4]))


def test_odds_of_nothing(spark):
    from verdigris.operators.purged import overfit_odds

    none = spark.createDataFrame([], "s string, f int, g double")
    assert [tuple(r) for r in overfit_odds(none, "s", "f", "g", 4).collect()] == [(0, 4, 0, 0.0, 0.0, 0.0)]
    one = spark.createDataFrame([("a", 0, 0.1)], "s string, f int, g double")
    assert overfit_odds(one, "s", "f", "g", 1).first().splits == 0


def test_quantile_and_haircuts(spark):
    from verdigris.functions.normal import normal_quantile
    from verdigris.operators.inference import haircut_sharpes, sharpe_haircuts

    ps = [1e-9, 0.001, 0.02425, 0.2, 0.5, 0.8, 0.99, 1 - 1e-9]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(normal_quantile(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-6, abs=1e-8)
    data = [(1, 0.30, 100), (2, -0.25, 100), (3, 0.05, 100), (4, 0.0, 100), (5, 0.9, 1)]
    rows = {r["series_id"]: r for r in haircut_sharpes(sharpe_haircuts(spark.createDataFrame(data, "series_id int, sharpe double, n long"))).collect()}
    assert 0 < rows[1].holm_sharpe < 0.30 and rows[1].holm_cut == pytest.approx(1 - rows[1].holm_sharpe / 0.30)
    assert -0.25 < rows[2].bhy_sharpe < 0 and (rows[4].holm_sharpe, rows[4].holm_cut) == (0, 0) and rows[5].holm_sharpe == 0
    assert (rows[3].bonferroni_sharpe, rows[3].bonferroni_cut) == (0, 1)


@pytest.fixture(scope="module")
def panel(spark):
    """Nine series over three chunks, some rows missing, null or doubled; d follows a."""
    rng, rows, at = random.Random(4), [], {}
    for t in range(120):
        for s in "abcdefghi":
            at[s] = at.get(s, 5.0) + rng.gauss(0, 0.02)
            x = 2 + 0.7 * at["a"] + rng.gauss(0, 0.01) if s == "d" else 3.0 if s == "i" else at[s]
            if rng.random() > 0.1:
                rows.append((s, t, x))
    rows += [("a", 500, None), (None, 3, 1.0), ("b", None, 1.0), ("z", 1, 1.0)] + [(s, t, x + 0.1) for s, t, x in rows[:5]]
    return rows, spark.createDataFrame(rows, "s string, t int, x double").cache()


@pytest.mark.parametrize("block", [2, 4, 256])
def test_regressions_equal_least_squares(spark, panel, block):
    from verdigris.operators.pairs import pair_regressions

    rows, df = panel
    got = {(r.a, r.b): r for r in pair_regressions(df, "s", "t", "x", F.floor(F.col("t") / 40), block).collect()}
    series = {}
    for s, t, x in rows:
        if None not in (s, t, x):
            series.setdefault(s, {}).setdefault(t, []).append(x)
    series = {s: {t: mean(v) for t, v in m.items()} for s, m in series.items()}
    want = 0
    for a, b in combinations(sorted(series), 2):
        common = sorted(set(series[a]) & set(series[b]))
        if len(common) < 2:
            assert (a, b) not in got
            continue
        want += 1
        y, x, r = [series[a][t] for t in common], [series[b][t] for t in common], got[a, b]
        slope, level = np.polyfit(x, y, 1) if b != "i" else (0.0, mean(y))
        assert (r.n, r.beta, r.alpha) == (len(common), pytest.approx(slope, abs=1e-6), pytest.approx(level, abs=1e-5))
    assert len(got) == want and got["a", "d"].corr > 0.95


def loop_adf(e):
    m = [(e[t] - e[t - 1], e[t - 1], e[t - 1] - e[t - 2]) for t in range(2, len(e))]
    y, x = np.array([r[0] for r in m]), np.array([r[1:] for r in m])
    inv = np.linalg.inv(x.T @ x)
    coefficients = inv @ x.T @ y
    return coefficients[0] / math.sqrt(((y - x @ coefficients) ** 2).sum() / (len(y) - 2) * inv[0, 0])


def test_stationarity_equals_least_squares(spark):
    from verdigris.operators.pairs import stationarity

    rng, paths = random.Random(8), {}
    for name, pull, n in (("pulled", 0.6, 200), ("walk", 1.0, 150), ("short", 0.5, 19)):
        x = [0.0]
        while len(x) < n:
            x.append(0.1 + pull * x[-1] + rng.gauss(0, 1))
        paths[name] = x
    rows = [(s, t, v) for s, xs in paths.items() for t, v in enumerate(xs)]
    got = {r.s: r for r in stationarity(spark.createDataFrame(rows, "s string, t int, e double"), ["s"], "t", "e").collect()}
    assert got["pulled"].adf == pytest.approx(loop_adf(paths["pulled"])) and got["walk"].adf == pytest.approx(loop_adf(paths["walk"]))
    assert got["pulled"].adf < -5 < got["walk"].adf and got["short"].adf == 0 and got["short"].kappa is None
    x = np.array(paths["pulled"])
    b, a = np.polyfit(x[:-1], x[1:], 1)
    left = ((x[1:] - a - b * x[:-1]) ** 2).sum() / (len(x) - 3)
    r = got["pulled"]
    assert (r.kappa, r.half_life, r.level, r.sigma_eq) == (pytest.approx(-math.log(b)), pytest.approx(math.log(2) / -math.log(b)), pytest.approx(a / (1 - b)), pytest.approx(math.sqrt(left / (1 - b * b))))


@pytest.mark.parametrize("chunk", [3, 10_000])
def test_spread_trades_equal_the_loop(spark, chunk):
    from verdigris.operators.pairs import spread_trades

    rng, window, entry, cost = random.Random(1), 20, 1.2, 0.003
    x, gap, path = 4.0, 0.0, []
    for t in range(160):
        x, gap = x + rng.gauss(0, 0.02), 0.8 * gap + rng.gauss(0, 0.02)
        path.append((x + 0.5 + gap, x))
    rows = [(p, q, t, y, z) for p, q in ((1, 2), (1, 3)) for t, (y, z) in enumerate(path)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", chunk)
    got = [r for r in spread_trades(spark.createDataFrame(rows, "a int, b int, at int, xa double, xb double"), window, entry, 0.0, cost).collect() if r.pair.b == 3]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got.sort(key=lambda r: r["at"])
    side, held, want, closed = 0, 0, [], []
    for t in range(len(path)):
        if t < window + 1:
            want.append(0.0)
            continue
        ys, xs = zip(*path[t - window : t])
        beta, alpha = np.polyfit(xs, ys, 1)
        left = [y - alpha - beta * z for y, z in zip(ys, xs)]
        z, last = (left[-1] - mean(left)) / stdev(left), side
        if side == 0:
            side = -1 if z > entry else 1 if z < -entry else 0
        elif side == 1 and z >= 0 or side == -1 and z <= 0:
            side = 0
        (ya, xa), (yb, xb) = path[t - 1], path[t]
        move = (math.exp(yb - ya) - 1 - beta * (math.exp(xb - xa) - 1)) / (1 + abs(beta))
        want.append(last * move - abs(side - last) / 2 * cost)
        if last and not side:
            closed.append(held)
        held = held + 1 if side else 0
    assert [r.net for r in got] == pytest.approx(want, abs=1e-9) and [r.closed for r in got if r.closed is not None] == closed and closed
