"""Every query that has SQL against that SQL on the smallest tables, and properties of the others."""

import math
import os
import random

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return f"{v + 0.0:.5g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    own = duckdb.connect()
    for t in TABLES:
        own.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return own


def names():
    from verdigris.plans.queries import SQL

    return sorted(SQL)


@pytest.mark.parametrize("name", names())
def test_query_matches_sql(spark, duck, name):
    from verdigris.plans.queries import QUERIES, SQL

    df = QUERIES[name](spark, DATA)
    want = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted("|".join(map(plain, r)) for r in df.select(*columns).collect())
    assert got == sorted("|".join(plain(r[i]) for i in at) for r in want.fetchall()) and got


def test_entry_has_a_row_a_nation(spark):
    import __spark_entry__

    assert 0 < __spark_entry__.entry(spark).count() <= 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_normal_distribution(spark):
    from pyspark.sql import functions as F
    from statistics import NormalDist
    from verdigris.functions.normal import expected_max, normal_cdf

    zs = [-4.0, -1.5, 0.0, 0.3, 2.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(normal_cdf(F.col("z"))).collect()]
    assert got == pytest.approx([NormalDist().cdf(z) for z in zs], abs=2e-7)
    assert expected_max(1) == 0 and expected_max(10) == pytest.approx(1.54, abs=0.05)


def test_moments_of_flat_and_null_series(spark):
    from verdigris.operators.summary import return_moments, tail_mean

    rows = spark.createDataFrame([("flat", i, 0.5) for i in range(5)] + [("ruin", 0, -1.0), ("ruin", 1, 0.5), ("ruin", 2, None)], "series_id string, idx int, r double")
    got = {r.series_id: r for r in return_moments(rows).collect()}
    assert (got["flat"].sharpe, got["flat"].skew, got["flat"].kurtosis) == (0, 0, 3)
    assert got["ruin"].total == -1 and got["ruin"].n == 2
    assert {r.series_id: r.cvar for r in tail_mean(rows).collect()} == {"flat": 0.5, "ruin": -1.0}
    assert return_moments(rows.limit(0)).collect() == []


def test_asof_matches_brute_force(spark):
    from datetime import datetime, timedelta

    from verdigris.operators.align import asof_last

    rng, t0 = random.Random(2), datetime(2024, 1, 1)
    events = [(i, rng.randrange(4), t0 + timedelta(minutes=rng.randrange(60)), rng.random()) for i in range(80)]
    probes = [(u, t0 + timedelta(minutes=m)) for u in range(5) for m in (0, 17, 59)]
    got = asof_last(spark.createDataFrame(probes, "user_id int, at timestamp"), spark.createDataFrame(events, "event_id int, user_id int, ts timestamp, value double"), "user_id", "at", "ts", "event_id", "value")
    found = {(r.user_id, r["at"]): r.value for r in got.collect()}
    for u, at in probes:
        before = [e for e in events if e[1] == u and e[2] <= at]
        assert found[u, at] == (max(before, key=lambda e: (e[2], e[0]))[3] if before else None)


def test_streamed_bars_equal_the_table_s(spark, tmp_path):
    from verdigris.streaming.bars import streaming_bars

    events = spark.read.parquet(f"{DATA}/events.parquet").selectExpr("event_id", "cast(ts as timestamp) ts", "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    job = streaming_bars(stream).writeStream.format("memory").queryName("bars").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    job.awaitTermination()
    assert sorted(spark.table("bars").collect()) == sorted(streaming_bars(events).collect())


def test_expanding_regime_leaves_its_own_row_out(spark):
    from verdigris.operators.rolling import expanding_regime

    data = [(1, i, r) for i, r in enumerate([0.0, 1.0, 3.0, 3.0, 3.0, -9.0, None, 1.0, 4.0])]
    rows = expanding_regime(spark.createDataFrame(data, "series_id int, idx int, r double"), n=2).orderBy("idx").collect()
    # deviations times the root of two: -, 1, 2, 0, 0, 12, -, -, 3
    assert [x["regime"] for x in rows] == "flat_low up_low up_high up_low up_low down_high flat_low flat_low up_high".split()
    assert rows[3]["mid"] == pytest.approx(1.5 / 2**0.5)
    assert expanding_regime(spark.createDataFrame([], "series_id int, idx int, r double")).count() == 0


def test_haircuts_stop_at_the_first_failure(spark):
    from verdigris.operators.inference import sharpe_haircuts

    data = [(1, 0.30, 100), (2, 0.22, 100), (3, 0.2199, 100), (4, 0.0, 100)]
    rows = {r["series_id"]: r for r in sharpe_haircuts(spark.createDataFrame(data, "series_id int, sharpe double, n long")).collect()}
    # p: 0.0027, 0.0278, 0.0279, 1: 0.0278 * 3 is over 0.05, so 0.0279 * 2 can't pass either
    assert [rows[i]["holm_significant"] for i in (1, 2, 3, 4)] == [True, False, False, False]
    assert rows[2]["holm_step"] > rows[3]["holm_step"] and rows[2]["holm"] == rows[3]["holm"]
