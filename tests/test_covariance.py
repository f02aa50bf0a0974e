"""Rolling covariances and their portfolios against plain loops; their queries against SQL."""

import random

import numpy as np
import pytest

from .test_queries import DATA, duck, plain  # noqa: F401


@pytest.mark.parametrize("name", ["trailing_covariances", "inverse_volatility"])
def test_query_matches_sql(spark, duck, name):  # noqa: F811
    from verdigris.plans import risk  # noqa: F401
    from verdigris.plans.queries import QUERIES, SQL

    df, want = QUERIES[name](spark, DATA), duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted("|".join(map(plain, r)) for r in df.select(*columns).collect())
    assert got == sorted("|".join(plain(r[i]) for i in at) for r in want.fetchall()) and got


@pytest.fixture(scope="module")
def panel(spark):
    rng, rows = random.Random(3), []
    for t in range(40):
        common = rng.gauss(0, 0.02)
        rows += [(s, t, common * k + rng.gauss(0, 0.01 * (k + 1))) for k, s in enumerate("abcd")] + [("flat", t, 0.25), ("gap", t, None if t == 20 else rng.gauss(0, 1)), ("late", t, rng.gauss(0, 1)) if t >= 30 else ("late", t, None)]
    rows += [(None, 3, 1.0), ("a", None, 1.0)]
    return rows, spark.createDataFrame(rows, "s string, t int, r double")


def test_covariances_equal_the_loop(panel):
    from verdigris.operators.covariance import trailing_covariances

    rows, df = panel
    got = {(r["at"], r.a, r.b): r.cov for r in trailing_covariances(df, "s", "t", "r", 8, 0.1).collect()}
    values, want = {(s, t): r for s, t, r in rows}, {}
    names = sorted({s for s, _, _ in rows if s})
    for t in range(8, 40):
        for i, a in enumerate(names):
            for b in names[i:]:
                x, y = ([values[s, u] for u in range(t - 8, t)] for s in (a, b))
                if None not in x + y:
                    want[t, a, b] = np.cov(x, y)[0, 1] * (1 if a == b else 0.9)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert not any("gap" in k and 21 <= k[0] <= 28 for k in got) and any("late" in k for k in got)


def test_weights_carry_equal_risk(spark, panel):
    from verdigris.operators.covariance import equal_risk_weights, inverse_volatility, trailing_covariances

    cov = trailing_covariances(panel[1], "s", "t", "r", 8)
    matrix = {(r["at"], r.a, r.b): r.cov for r in cov.collect()}
    by_time = {}
    for r in equal_risk_weights(cov).collect():
        by_time.setdefault(r["at"], {})[r.series] = r
    assert set(by_time) == set(range(8, 40))
    for t, ws in by_time.items():
        assert "flat" not in ws and all(r.met and r.weight > 0 for r in ws.values())
        names = sorted(ws)
        c = np.array([[matrix[(t, *sorted((a, b)))] for b in names] for a in names])
        w = np.array([ws[s].weight for s in names])
        parts = w * (c @ w)
        assert w.sum() == pytest.approx(1) and parts / parts.sum() == pytest.approx(np.full(len(w), 1 / len(w)), abs=1e-6)
    weights = {(r["at"], r.series): r.weight for r in inverse_volatility(cov).collect()}
    assert weights[20, "flat"] > 0.99 and sum(v for k, v in weights.items() if k[0] == 20) == pytest.approx(1)
    none = cov.limit(0)
    assert equal_risk_weights(none).count() == 0 and inverse_volatility(none).count() == 0


def test_returns_after_cost(spark):
    from verdigris.operators.covariance import weighted_returns

    weights = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", 0.8), (2, "b", 0.2)], "at int, series string, weight double")
    panel = spark.createDataFrame([("a", 1, 0.1), ("b", 1, None), ("a", 2, 0.2)], "s string, t int, r double")
    rows = {r["at"]: r for r in weighted_returns(weights, panel, "s", "t", "r", 0.01).collect()}
    assert (rows[1].gross, rows[1].turnover, rows[1].net) == (pytest.approx(0.05), 1.0, pytest.approx(0.04))
    assert (rows[2].gross, rows[2].turnover) == (pytest.approx(0.16), pytest.approx(0.6))
