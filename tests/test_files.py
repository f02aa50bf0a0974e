"""Files of returns and panels with located errors, and the ledger of trials."""

import pytest
from pyspark.sql import functions as F

from .test_queries import DATA, duck, plain  # noqa: F401


def write(folder, **texts):
    for name, text in texts.items():
        (folder / f"{name}.csv").write_bytes(text.encode())
    return str(folder)


def by_file(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.file, r.line or 0)):
        out.setdefault(r.file.rsplit("/", 1)[-1][:-4], []).append(r)
    return out


@pytest.mark.parametrize("name", ["returns_files", "trial_ledger"])
def test_query_matches_sql(spark, duck, name):  # noqa: F811
    from verdigris.plans import stores  # noqa: F401
    from verdigris.plans.queries import QUERIES, SQL

    df, want = QUERIES[name](spark, DATA), duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted("|".join(map(plain, r)) for r in df.select(*columns).collect())
    assert got == sorted("|".join(plain(r[i]) for i in at) for r in want.fetchall()) and got


def test_returns_and_their_errors(spark, tmp_path):
    from verdigris.sources.files import checked, read_returns

    path = write(
        tmp_path, plain="returns\n0.01\n-0.02\n.5\n", alias="PnL,Weight\n1e-2,1\n+0.5,-1\n", dated="\ufeff Date , Ret \n\n 2024-01-01 , 0.5 \n   \n2024-01-02,1.\n", **{"b c%d": "ret\n7\n"}, crlf="return\r\n0.1\r\n0.2\r\n", cr="ret\r0.1\r",
        none="a,b\n1,2\n", bad="ret,pos\n0.1,1\nabc,1\n,1\n0.2,x\n0.3\nInfinity,1\n1e999,1\n1d,1\n", empty="", blank="\n \n", header="ret\n",
    )
    got = by_file(read_returns(spark, path))
    values = lambda name, *c: [tuple(r[x] for x in c) for r in got[name]]
    assert values("plain", "line", "ret", "position", "date", "error") == [(2, 0.01, None, None, None), (3, -0.02, None, None, None), (4, 0.5, None, None, None)]
    assert values("alias", "ret", "position") == [(0.01, 1.0), (0.5, -1.0)]
    assert values("dated", "line", "date", "ret", "error") == [(2, "2024-01-01", 0.5, None), (3, "2024-01-02", 1.0, None)]
    assert values("crlf", "ret") == [(0.1,), (0.2,)] and values("cr", "ret") == [(0.1,)]
    assert values("none", "line", "error") == [(1, "no returns column")]
    assert values("empty", "line", "error") == values("blank", "line", "error") == [(None, "no header")]
    assert "header" not in got and sum(r.ret == 7.0 for rs in got.values() for r in rs) == 1
    assert values("bad", "line", "ret", "error")[:5] == [(2, 0.1, None), (3, None, "ret: not a number: abc"), (4, None, "ret: empty value"), (5, 0.2, "pos: not a number: x"), (6, 0.3, "pos: empty value")]
    assert [r.ret for r in got["bad"][5:]] == [None] * 3 and all(r.error for r in got["bad"][5:])
    assert checked(read_returns(spark, f"{path}/plain.csv")).count() == 3
    with pytest.raises(Exception, match="bad.csv:3: ret: not a number: abc"):
        checked(read_returns(spark, f"{path}/bad.csv").filter("line = 3")).collect()


def test_lines_are_numbered_over_splits(spark, tmp_path):
    from verdigris.sources.files import read_returns

    path = write(tmp_path, long="ret\n" + "".join(f"{i}\n" + "\n" * (i % 3) for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1500)
    got = read_returns(spark, path).select("line", "ret")
    assert spark.read.text(path).rdd.getNumPartitions() > 4
    rows = sorted(map(tuple, got.collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == [(i + 2, float(i)) for i in range(3000)]


def test_panels_and_their_errors(spark, tmp_path):
    from verdigris.sources.files import read_panel

    path = write(tmp_path, wide="\ufeffA, Timestamp ,b c\n1,2024-01-01,2\n\n3 , 2024-01-02\n", undated="A,B\n1,2\n", alone="date\n2024-01-01\n", bad="date,x\nd1,1\nd2,oops\n", empty="")
    got = by_file(read_panel(spark, path))
    assert sorted((r.line, r.date, r.asset, r.value, r.error) for r in got["wide"] if r.value) == [(2, "2024-01-01", "A", 1.0, None), (2, "2024-01-01", "b c", 2.0, None), (3, "2024-01-02", "A", 3.0, None)]
    assert [(r.line, r.asset, r.error) for r in got["wide"] if r.error] == [(3, "b c", "b c: empty value")]
    assert [[r.error for r in got[k]] for k in ("undated", "alone", "empty")] == [["no date column"], ["no asset columns"], ["no header"]]
    assert [(r.line, r.value, r.error) for r in got["bad"]] == [(2, 1.0, None), (3, None, "x: not a number: oops")]


def test_ledger_counts_reruns_once(spark, tmp_path):
    from verdigris.sources.files import read_trials, record_trials, trial_counts

    path = str(tmp_path / "ledger")
    rows = spark.createDataFrame([("x|y", "z"), ("x", "y|z"), (None, "q"), ("", "q"), ("", "q")], "b string, a string")
    record_trials(rows, ["b", "a"], path, "7", F.lit("f"), F.lit("t1"))
    record_trials(rows.limit(0), ["a", "b"], path, "none")
    record_trials(rows, ["a", "b"], path, "7", F.lit("f"), F.lit("t1"))
    assert read_trials(spark, path).count() == 5
    record_trials(rows, ["a", "b"], path, "a/b=c d", F.lit("f"))
    trials = read_trials(spark, path)
    assert {r.run_id for r in trials.collect()} == {"7", "a/b=c d"} and {r.timestamp for r in trials.collect()} == {"t1", None}
    assert [tuple(r) for r in trial_counts(trials).collect()] == [("f", 4, 10)]


def test_equal_trials_are_one_line(spark, tmp_path):
    from verdigris.sources.files import read_ledger, read_trials, record_trials, trial_counts

    path = str(tmp_path / "ledger")
    rows = spark.range(20_000).select((F.col("id") % 2).alias("a"), F.lit(None).cast("string").alias("b"))
    record_trials(rows, ["a", "b"], path, "r", F.lit("f"))
    assert spark.read.text(path).count() == 2
    assert {tuple(r)[1:] for r in read_ledger(spark, path).collect()} == {("f", None, 10_000, "r")}
    assert [r["count"] for r in read_trials(spark, path).groupBy("hash").count().collect()] == [10_000] * 2
    # lines of one trial each, without a number
    (tmp_path / "ledger" / "run_id=old").mkdir()
    (tmp_path / "ledger" / "run_id=old" / "x.json").write_text('{"hash":"h","label":"f"}\n' * 2)
    for trials in (read_ledger(spark, path), read_trials(spark, path)):
        assert [tuple(r) for r in trial_counts(trials).collect()] == [("f", 3, 20_002)]
