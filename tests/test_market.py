"""Edge cases of indicators, forward joins, sets and ruin, against plain Python."""

import math

from pyspark.sql import functions as F


def series(spark, values, name="r"):
    return spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(values)], f"series_id long, idx long, {name} double")


def test_ruin_is_a_total_loss(spark):
    from verdigris.operators.summary import drawdown

    row = drawdown(series(spark, [0.5, -1.0, 0.5])).first()
    assert (row.total, row.max_drawdown, row.annual) == (-1.0, 1.0, -1.0)
    row = drawdown(series(spark, [0.5, -0.5, None, 0.5])).first()
    assert math.isclose(row.max_drawdown, 0.5) and math.isclose(row.total, 0.125)


def test_next_event_matches_brute_force(spark):
    from verdigris.operators.align import asof_next

    left = [(i, i % 3, (i * 7) % 20) for i in range(12)]
    right = [(100 + i, i % 2, (i * 5) % 18, float(i)) for i in range(9)] + [(90, 0, 5, -1.0)]
    got = asof_next(spark.createDataFrame(left, "id long, k int, at int"), spark.createDataFrame(right, "id long, k int, at int, v double"), "k", "at", "id", "v")
    want = []
    for i, k, at in left:
        later = min(((t, j, v) for j, b, t, v in right if b == k and t >= at), default=(None, None, None))
        want.append((i, later[1], later[2]))
    assert sorted((r.id, r.next_id, r.next_value) for r in got.collect()) == want


def test_windows_wait_until_they_are_full(spark):
    from verdigris.operators import indicators

    rows = series(spark, [3.0, 3.0, 3.0, 5.0, 1.0], "v")
    got = indicators.stochastic(rows, n=3, smooth=2).orderBy("idx").collect()
    assert [r.raw_k for r in got] == [None, None, 50.0, 100.0, 0.0] and [r.k for r in got] == [None, None, None, 75.0, 50.0]
    got = indicators.prior_bands(rows, n=3).orderBy("idx").collect()
    assert [r.entry for r in got] == [0, 0, 0, 1, -1] and got[3].mid == 3.0 and got[2].mid is None
    got = indicators.moving_statistics(rows, n=3).orderBy("idx").collect()
    assert [r.full_mean for r in got][:3] == [None, None, 3.0] and got[1].partial_mean == 3.0 and got[2].z == 0.0


def test_bars(spark):
    from verdigris.operators import indicators

    bars = spark.createDataFrame([(1, i, h, low, c) for i, (h, low, c) in enumerate([(5.0, 1.0, 3.0), (9.0, 8.0, 8.5), (4.0, 2.0, 3.0)])], "k int, at int, high double, low double, close double")
    got = indicators.true_range(bars, "k", "at", n=2).orderBy("at").collect()
    assert [r.tr for r in got] == [None, 6.0, 6.5] and [r.atr for r in got] == [4.0, 6.0, 6.25]
    got = indicators.floor_pivots(bars, "k", "at").orderBy("at").collect()
    assert got[0].pp is None and (got[1].pp, got[1].r1, got[1].s1, got[1].r2, got[1].s2) == (3.0, 5.0, 1.0, 7.0, -1.0)
    flat = bars.withColumns({c: F.lit(2.0) for c in ("high", "low", "close")})
    assert [r.cci for r in indicators.channel_index(flat, "k", "at", n=2).orderBy("at").collect()] == [None, 0.0, 0.0]


def test_sets(spark):
    from verdigris.operators import sets

    log = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z"), ("a", 3, "z")], "k string, seq int, v string")
    assert sorted(map(tuple, sets.last_wins(log, "k", "seq", "v").collect())) == [("a", "z", 1, 3), ("b", "y", 2, 1)]
    assert sorted(map(tuple, sets.consume_once(log, log.filter("k = 'b'"), ["k"], "seq").collect())) == [("a", 1, "x")]
    assert sorted(map(tuple, sets.in_all(log.withColumn("who", F.col("v")).union(log.select("k", "seq", "v", F.lit("w"))), "who", "k", "seq").collect())) == []
    assert sorted(map(tuple, sets.in_all(log.crossJoin(spark.createDataFrame([(1,), (2,)], "who int")), "who", "k", "seq").collect())) == [("a", 1), ("b", 2)]
    assert sorted(map(tuple, sets.distinct_trials(log, "k", ["v"]).collect())) == [("a", 2, 3), ("b", 1, 1)]
    assert sorted(map(tuple, sets.first_layer_union(log, ["k"], "seq").collect())) == [("a", 1, 3), ("b", 2, 1)]


def test_sets_tell_values_apart(spark):
    from verdigris.operators import sets

    log = spark.createDataFrame([("f", "x|y", "z", 1), ("f", "x", "y|z", 2), ("f", None, "q", 3), ("f", "", "q", 4), ("f", "", "q", 5)], "k string, a string, b string, seq int")
    assert tuple(sets.distinct_trials(log, "k", ["a", "b"]).first()) == ("f", 4, 5)
    left = sets.consume_once(log, log.filter("a IS NULL"), ["k", "a"], "seq").collect()
    assert sorted(r.seq for r in left) == [1, 2, 4]


def test_changes_are_between_weeks_side_by_side(spark):
    import datetime

    from verdigris.operators import indicators

    days = [("s", datetime.date(2024, 1, d), float(v)) for d, v in ((1, 1), (3, 2), (8, 3), (22, 6))]
    got = indicators.week_closes(spark.createDataFrame(days, "k string, day date, v double"), "k", "day", "v").orderBy("week").collect()
    assert [(r.close, r.change) for r in got] == [(2.0, None), (3.0, 0.5), (6.0, None)]


def test_yearly_rates_count_series_alike(spark):
    import datetime

    from verdigris.operators import indicators

    rows = [("a", datetime.date(2024, 1, d), 0.01) for d in range(1, 10)] + [("b", datetime.date(2024, 2, 1), 0.03), ("b", datetime.date(2024, 2, 2), None), ("b", datetime.date(2025, 2, 2), -0.01)]
    got = indicators.yearly_rates(spark.createDataFrame(rows, "k string, day date, r double"), "k", "day", "r", year=100).orderBy("year").collect()
    assert [(r.year, r.series, r.n, round(r.apr, 9)) for r in got] == [(2024, 2, 10, 2.0), (2025, 1, 1, -1.0)]


def test_fits(spark):
    from verdigris.operators import indicators

    rows = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(zip(range(12), [1, 3, 2, 5, 4, 7, 6, 9, 8, 11, 10, 13]))] + [(2, 0, 1.0, 1.0)], "k int, i int, x double, y double")
    got = {r.k: r for r in indicators.slope_t(rows, "k", "x", "y").collect()}
    assert (got[2].beta, got[2].t) == (None, None) and math.isclose(got[1].beta, 1.0, abs_tol=0.05) and got[1].t > 10
    got = {r.k: r for r in indicators.ordinal_spearman(rows, "k", "x", "y", "i").collect()}
    assert got[1].n == 12 and 0.9 < got[1].spearman < 1
    assert indicators.annual_sharpe(series(spark, [0.1, 0.1]), "series_id").first().sharpe == 0.0
