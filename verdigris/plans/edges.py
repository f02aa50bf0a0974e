"""Queries of resampling, walk-forward and higher timeframes, and the SQL that they are compared with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import carried, resample, walkforward
from ..sources.tables import daily_series
from .market import bars_of
from .queries import BARS, DAILY, WEEKLY, query, rounded, weekly_panel


def draw_sql(source: str, seed: int, k: str, name: str, out: str) -> str:
    """Common table expressions that end in ``out``: ``source`` with draw ``k`` as ``name``."""
    mul = "((({})::HUGEINT * ({})) % 4294967296)::BIGINT".format
    return f"""{out}_a AS (SELECT *, ({seed} + {mul(resample.INCREMENT, k)}) % 4294967296 AS x FROM {source}),
{out}_b AS (SELECT * REPLACE ({mul("xor(x, x >> 15)", "x | 1")} AS x) FROM {out}_a), {out}_c AS (SELECT * REPLACE (xor(x, (x + {mul("xor(x, x >> 7)", "x | 61")}) % 4294967296) AS x) FROM {out}_b),
{out} AS (SELECT * EXCLUDE (x), xor(x, x >> 14) / 4294967296.0 AS {name} FROM {out}_c)"""


@query(DAILY + f""", y AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY idx) - 1 AS at, r FROM s WHERE r IS NOT NULL), w AS (SELECT series_id, count(*) AS n, greatest(1, CAST(round(sqrt(count(*))) AS BIGINT)) AS block FROM y GROUP BY 1),
dd AS (SELECT *, unnest(range(0, 100)) AS resample FROM w), p AS (SELECT *, unnest(range(0, CAST(ceil(n / block) AS BIGINT))) AS part FROM dd), {draw_sql("p", resample.seed_of("block-bootstrap"), "resample * CAST(ceil(n / block) AS BIGINT) + part + 1", "u", "q")},
o AS (SELECT series_id, n, resample, (CAST(floor(u * n) AS BIGINT) + unnest(range(0, least(block, n - part * block)))) % n AS at FROM q), v AS (SELECT o.series_id, o.resample, o.n, y.r FROM o JOIN y ON y.series_id = o.series_id AND y.at = o.at),
f AS (SELECT series_id, avg(r) AS mean, CASE WHEN stddev_samp(r) > 1e-12 THEN avg(r) / stddev_samp(r) ELSE 0 END AS sharpe, exp(sum(ln(1 + r))) - 1 AS compound FROM v GROUP BY series_id, resample),
e AS (SELECT series_id, avg(r) AS mean, CASE WHEN stddev_samp(r) > 1e-12 THEN avg(r) / stddev_samp(r) ELSE 0 END AS sharpe, exp(sum(ln(1 + r))) - 1 AS compound FROM y GROUP BY 1)
SELECT series_id, n, block, {", ".join(f"round(any_value(e.{c}), 6) + 0.0 AS {c}, round(quantile_cont(f.{c}, 0.025), 6) + 0.0 AS {c}_lower, round(quantile_cont(f.{c}, 0.975), 6) + 0.0 AS {c}_upper" for c in resample.STATISTICS)} FROM e JOIN w USING (series_id) JOIN f USING (series_id) GROUP BY ALL""")
def block_bootstrap(spark, sf_dir):
    return rounded(resample.block_bootstrap(daily_series(spark, sf_dir), "series_id", "idx", "r", iterations=100))


@query(WEEKLY + f""", a AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY week) - 1 AS spot, coalesce(r, 0) AS x FROM p), z AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM a GROUP BY series_id)), y AS (SELECT a.*, n FROM a, z WHERE a.spot < n),
i AS (SELECT n, CAST(floor(id / n) AS BIGINT) AS resample, id % n AS t, id FROM (SELECT n, unnest(range(0, 100 * n)) AS id FROM z)), {draw_sql("i", resample.seed_of("spa"), "id + 1", "u", "j")}, k AS (SELECT * FROM j WHERE t = 0 OR u < 1.0 / greatest(1, CAST(floor(sqrt(n) + 0.5) AS BIGINT))),
{draw_sql("k", resample.seed_of("spa:start"), "id + 1", "v", "l")}, m AS (SELECT i.resample, (CAST(floor(l.v * i.n) AS BIGINT) + i.t - l.t) % i.n AS spot FROM i ASOF JOIN l ON i.id >= l.id),
h AS (SELECT series_id, resample, avg(x) AS drawn FROM m JOIN y USING (spot) GROUP BY ALL), c AS (SELECT series_id, any_value(n) AS n, avg(x) AS mean, stddev_samp(x) AS omega FROM y GROUP BY 1), t AS (SELECT *, CASE WHEN omega > 1e-12 THEN sqrt(n) * mean / omega ELSE 0 END AS studentized FROM c),
b AS (SELECT greatest(0, max(studentized)) AS best FROM t), gg AS (SELECT resample, greatest(0, max(sqrt(n) * (drawn - CASE WHEN studentized >= -sqrt(2 * ln(ln(n))) THEN mean ELSE 0 END) / omega)) AS most FROM h JOIN t USING (series_id) GROUP BY 1),
pv AS (SELECT sum(CASE WHEN most >= best THEN 1 ELSE 0 END) / 100 AS p_value FROM gg, b), u1 AS (SELECT t1.series_id, resample, max(sqrt(t2.n) * (drawn - t2.mean) / t2.omega) AS most FROM t t1 JOIN t t2 ON t2.studentized <= t1.studentized JOIN h ON h.series_id = t2.series_id GROUP BY ALL),
cr AS (SELECT series_id, quantile_cont(most, 0.95) AS critical FROM u1 GROUP BY 1), st AS (SELECT coalesce(max(studentized), -1e300) AS stop FROM t JOIN cr USING (series_id) WHERE studentized <= critical)
SELECT series_id, round(mean, 8) + 0.0 AS mean, round(studentized, 6) + 0.0 AS studentized, p_value, round(critical, 6) + 0.0 AS critical, studentized > stop AS rejected FROM t JOIN cr USING (series_id), pv, st""")
def predictive_ability(spark, sf_dir):
    rows = resample.predictive_ability(weekly_panel(spark, sf_dir), "series_id", "week", "r", iterations=100)
    return rows.select(F.col("series_id").cast("long").alias("series_id"), (F.round("mean", 8) + F.lit(0.0)).alias("mean"), (F.round("studentized", 6) + F.lit(0.0)).alias("studentized"), "p_value", (F.round("critical", 6) + F.lit(0.0)).alias("critical"), "rejected")


@query("WITH RECURSIVE " + BARS.format(600).removeprefix("WITH ") + """, o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY bar) AS i FROM b), g AS (SELECT *, CASE WHEN i = 1 THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM o WINDOW w AS (PARTITION BY event_type ORDER BY i)),
z AS (SELECT event_type, bar, i, close, tr AS atr, (high + low) / 2 + 3 * tr AS upper, (high + low) / 2 - 3 * tr AS lower, close >= (high + low) / 2 - 3 * tr AS up FROM g WHERE i = 1
UNION ALL SELECT event_type, bar, i, close, atr, upper, lower, CASE WHEN was THEN close >= lower ELSE close > upper END FROM (SELECT n.event_type, n.bar, n.i, n.close, n.atr, z.up AS was,
  CASE WHEN n.mid + 3 * n.atr < z.upper OR z.close > z.upper THEN n.mid + 3 * n.atr ELSE z.upper END AS upper, CASE WHEN n.mid - 3 * n.atr > z.lower OR z.close < z.lower THEN n.mid - 3 * n.atr ELSE z.lower END AS lower
  FROM (SELECT g.event_type, g.bar, g.i, g.close, (g.high + g.low) / 2 AS mid, (y.atr * 9 + g.tr) / 10 AS atr FROM z y JOIN g ON g.event_type = y.event_type AND g.i = y.i + 1) n JOIN z ON z.event_type = n.event_type AND z.i = n.i - 1))
SELECT event_type, bar, CASE WHEN i <= 11 THEN 0 WHEN up THEN 1 ELSE -1 END AS position FROM z""")
def supertrend_positions(spark, sf_dir):
    return carried.supertrend(bars_of(spark, sf_dir), "event_type", "bar")


@query()
def renko_directions(spark, sf_dir):
    w = Window.partitionBy("series_id").orderBy("idx").rowsBetween(-19, 0)
    rows = daily_series(spark, sf_dir).withColumn("size", 0.25 * F.avg("v").over(w))
    return carried.renko(rows, "series_id", "idx", "v", "size", 2)


@query(WEEKLY + """, t AS (SELECT series_id, week, CASE WHEN abs(signal) > 0.2 THEN signal ELSE 0 END AS target FROM p), a AS (SELECT week, max(CASE WHEN coalesce(target, 0) <> 0 THEN 1 ELSE 0 END) AS anyone FROM t GROUP BY 1),
u AS (SELECT series_id, week, coalesce(target, 0) AS target, sign(coalesce(target, 0)) AS side FROM t JOIN a USING (week) WHERE anyone = 1), n AS (SELECT *, coalesce(side <> lag(side) OVER w, true) AS new FROM u WINDOW w AS (PARTITION BY series_id ORDER BY week)),
k AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY week) AS run FROM n), h AS (SELECT series_id, week, first_value(target) OVER (PARTITION BY series_id, run ORDER BY week) AS held FROM k)
SELECT t.series_id, t.week, round(coalesce(h.held, 0), 6) + 0.0 AS held FROM t ASOF LEFT JOIN h ON h.series_id = t.series_id AND h.week <= t.week""")
def banded_positions(spark, sf_dir):
    rows = weekly_panel(spark, sf_dir).withColumn("target", F.when(F.abs("signal") > 0.2, F.col("signal")).otherwise(0.0))
    return rounded(carried.banded(rows, "series_id", "week", "target"))


@query(DAILY + """, x AS (SELECT series_id, idx, coalesce(r, 0) AS rate, coalesce(abs(lag(r) OVER w), 0) AS move, coalesce(lag(coalesce(r, 0)) OVER w > 0, false) AS was, lead(idx) OVER w IS NULL AS final FROM s WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
y AS (SELECT *, was OR rate > 0 AS held, rate > 0 AND NOT was AS entered, was AND move > 0.01 AS trued, CASE WHEN rate > 0 AND final THEN 0.0008 ELSE 0 END AS unwind FROM x),
z AS (SELECT *, CASE WHEN held THEN rate ELSE 0 END AS funding, 0.0008 * CAST(entered AS INT) + 0.0004 * CAST(trued AS INT) + CASE WHEN was AND rate <= 0 THEN 0.0008 ELSE 0 END + unwind AS fee FROM y),
g AS (SELECT series_id, count(*) AS intervals, sum(CAST(held AS INT)) AS held, sum(CAST(entered AS INT)) AS entries, sum(CAST(trued AS INT)) AS rebalances, sum(fee) AS fees, sum(ln(1 + funding)) AS gross, sum(ln(1 + funding - fee + unwind) + ln(1 - unwind)) AS net, avg(funding - fee) AS mean_net FROM z GROUP BY 1)
SELECT series_id, intervals, CAST(held AS BIGINT) AS held, CAST(entries AS BIGINT) AS entries, CAST(rebalances AS BIGINT) AS rebalances, round(CAST(fees AS DOUBLE), 6) AS fees, round(exp(gross) - 1, 6) AS gross_yield, round(exp(net) - 1, 6) + 0.0 AS net_yield, round(ln(1 + exp(gross / held * 1095.75) - 1), 4) AS gross_log_apr, round(net / intervals * 1095.75, 4) + 0.0 AS net_log_apr, round(mean_net, 6) + 0.0 AS mean_net FROM g""")
def funding_carry(spark, sf_dir):
    rows = daily_series(spark, sf_dir).withColumn("basis", F.lag("r").over(Window.partitionBy("series_id").orderBy("idx")))
    got = carried.carry_summary(carried.funding_carry(rows, "series_id", "idx", "r", "basis"), "series_id")
    logs = [F.round(F.log1p(f"{c}_apr"), 4).alias(f"{c}_log_apr") for c in ("gross", "net")]
    return rounded(got.select("series_id", "intervals", "held", "entries", "rebalances", "fees", "gross_yield", "net_yield", *logs, "mean_net"))


@query("WITH RECURSIVE " + DAILY.removeprefix("WITH ") + """, e AS (SELECT series_id, idx - 1 AS i, v, max(idx) OVER (PARTITION BY series_id) - 1 AS final FROM s), j AS (SELECT a.series_id, a.i, min(b.i) FILTER (b.v / a.v - 1 >= 0.5 OR b.v / a.v - 1 <= -0.3 OR b.i = a.final OR b.i = a.i + 10) AS exit FROM e a JOIN e b ON b.series_id = a.series_id AND b.i BETWEEN a.i + 1 AND a.i + 10 GROUP BY ALL),
c AS (SELECT series_id, i AS entry, exit FROM j WHERE i = 0 UNION ALL SELECT j.series_id, j.i, j.exit FROM c JOIN j ON j.series_id = c.series_id AND j.i = c.exit + 1),
t AS (SELECT c.*, b.v / a.v - 1 AS pnl FROM c JOIN e a ON a.series_id = c.series_id AND a.i = c.entry JOIN e b ON b.series_id = c.series_id AND b.i = c.exit)
SELECT series_id, count(*) AS trades, count(*) FILTER (pnl >= 0.5) AS taken, count(*) FILTER (pnl <= -0.3) AS stopped, count(*) FILTER (pnl < 0.5 AND pnl > -0.3) AS timed, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate, round(sum(pnl), 4) AS total FROM t GROUP BY 1""")
def bracket_outcomes(spark, sf_dir):
    trades = carried.bracket_trades(daily_series(spark, sf_dir), "series_id", "idx", "v", 0.5, 0.3, 10)
    return rounded(carried.bracket_outcomes(trades, "series_id").withColumn("total", F.round("total", 4)))


@query(DAILY + """, n AS (SELECT series_id, idx, r, (idx - 1) // 8 AS b FROM s), k AS (SELECT series_id, b + 1 AS b, CASE WHEN sum(coalesce(r, 0)) > 0.01 THEN 'up' WHEN sum(coalesce(r, 0)) < -0.01 THEN 'down' ELSE 'flat' END AS bias FROM n GROUP BY series_id, b),
o AS (SELECT n.*, coalesce(bias, 'flat') AS bias, sign(coalesce(r, 0)) AS side FROM n LEFT JOIN k USING (series_id, b)) SELECT series_id, idx, bias, CASE WHEN (side > 0 AND bias = 'up') OR (side < 0 AND bias = 'down') THEN CAST(side AS DOUBLE) ELSE 0.0 END AS gated FROM o""")
def higher_timeframe_gate(spark, sf_dir):
    rows = walkforward.higher_bias(daily_series(spark, sf_dir), "series_id", "idx", "r", 8, 0.01).withColumn("side", F.signum(F.coalesce("r", F.lit(0.0))))
    return walkforward.bias_gate(rows, "side", "bias", block_on_flat=True).select(F.col("series_id").cast("long").alias("series_id"), F.col("idx").cast("long").alias("idx"), "bias", (F.col("gated") + F.lit(0.0)).alias("gated"))


GRID = DAILY + """, n AS (SELECT series_id, idx - 1 AS i, v, v / lag(v) OVER w - 1 AS change, """ + ", ".join(f"CASE WHEN idx >= {k} AND v > avg(v) OVER (PARTITION BY series_id ORDER BY idx ROWS {k - 1} PRECEDING) THEN 1.0 ELSE 0 END AS p{k}" for k in (5, 10, 20, 40)) + """ FROM s WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
q AS (""" + " UNION ALL ".join(f"SELECT series_id, i, {k} AS param, coalesce(lag(p{k}) OVER w, 0) * change - 0.001 * abs(coalesce(lag(p{k}) OVER w, 0) - coalesce(lag(p{k}, 2) OVER w, 0)) AS net FROM n WINDOW w AS (PARTITION BY series_id ORDER BY i)" for k in (5, 10, 20, 40)) + """),
m AS (SELECT * FROM q WHERE net IS NOT NULL), b AS (SELECT series_id, unnest(range(120, max(i) + 2, 30)) AS step FROM m GROUP BY 1), k AS (SELECT m.series_id, step, param, CASE WHEN stddev_samp(net) > 1e-12 THEN avg(net) / stddev_samp(net) ELSE 0 END AS sharpe FROM b JOIN m ON m.series_id = b.series_id AND m.i BETWEEN step - 119 AND step - 1 GROUP BY ALL),
c AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY series_id, step ORDER BY round(sharpe, 9) DESC, param) = 1)"""


def grid(spark, sf_dir):
    return walkforward.grid_returns(daily_series(spark, sf_dir), "series_id", "idx", "v", [5, 10, 20, 40], 0.001)


@query(GRID + " SELECT c.series_id, c.step, any_value(c.param)::BIGINT AS param, round(any_value(c.sharpe), 6) + 0.0 AS sharpe, count(m.net) AS n, round(coalesce(sum(m.net), 0), 6) + 0.0 AS net FROM c LEFT JOIN m ON m.series_id = c.series_id AND m.param = c.param AND m.i BETWEEN c.step AND c.step + 29 GROUP BY ALL")
def walk_forward(spark, sf_dir):
    choices, rows = walkforward.walk_forward(grid(spark, sf_dir), "series_id", 120, 30)
    sums = rows.groupBy("series_id", "step").agg(F.count("net").alias("n"), F.sum("net").alias("net"))
    return rounded(choices.join(sums, ["series_id", "step"], "left").select("series_id", "step", "param", "sharpe", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("net", F.lit(0.0)).alias("net")))


@query(GRID + """, l AS (SELECT *, lag(param) OVER (PARTITION BY series_id ORDER BY step) AS last, avg(param) OVER (PARTITION BY series_id) AS mean FROM c)
SELECT series_id, count(*) AS steps, round(coalesce(sum(abs(param - last)), 0) / greatest(count(*) - 1, 1), 6) AS mean_step, round(count(*) FILTER (param <> last) / greatest(count(*) - 1, 1), 6) AS changed, round(CASE WHEN sum((param - mean) ** 2) > 0 THEN coalesce(sum((param - mean) * (last - mean)), 0) / sum((param - mean) ** 2) ELSE 0 END, 6) + 0.0 AS lag1 FROM l GROUP BY 1""")
def param_drift(spark, sf_dir):
    return rounded(walkforward.param_drift(walkforward.walk_forward(grid(spark, sf_dir), "series_id", 120, 30)[0], "series_id"))
