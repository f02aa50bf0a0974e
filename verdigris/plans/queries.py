"""Queries over the stored tables, one or more for each group of operators, and the SQL that they are compared with.

Doubles are rounded on both sides, as sums depend on the order of their terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normal import expected_max, normal_cdf_sql
from ..operators import align, backtest, inference, rolling, summary
from ..sources.tables import daily_series, event_bars, nation_values, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DAILY = """WITH d AS (SELECT CAST(c_nationkey AS BIGINT) AS series_id, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
s AS (SELECT series_id, day, v, row_number() OVER w AS idx, ln(v / lag(v) OVER w) / 50 AS r FROM d WINDOW w AS (PARTITION BY series_id ORDER BY day))"""
WEEKLY = """WITH d AS (SELECT CAST(c_nationkey AS BIGINT) AS series_id, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
g AS (SELECT series_id, CAST(unnest(generate_series(f, l, INTERVAL 7 DAY)) AS DATE) AS week FROM (SELECT series_id, min(week) AS f FROM d GROUP BY 1), (SELECT max(week) AS l FROM d)),
f AS (SELECT g.series_id, g.week, d.v, last_value(d.v IGNORE NULLS) OVER (PARTITION BY g.series_id ORDER BY g.week) AS filled FROM g LEFT JOIN d ON d.series_id = g.series_id AND d.week = g.week),
p AS (SELECT series_id, week, filled, ln(filled / lag(filled, 4) OVER w) AS signal, ln(filled / lag(filled) OVER w) / 50 AS r, ln(lead(filled) OVER w / filled) / 50 AS fwd FROM f WINDOW w AS (PARTITION BY series_id ORDER BY week))"""
MOMENTS = """, q AS (SELECT series_id, count(r) AS n, avg(r) AS mean, coalesce(stddev_samp(r), 0) AS sd, avg(r*r) AS m2, avg(r*r*r) AS m3, avg(r*r*r*r) AS m4, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS positive_rate,
  exp(sum(ln(1 + r))) - 1 AS total, min(r) AS least, max(r) AS largest FROM s WHERE r IS NOT NULL GROUP BY 1),
m AS (SELECT series_id, n, mean, sd, positive_rate, total, least, largest, CASE WHEN sd <= 1e-12 THEN 0 ELSE mean / sd END AS sharpe, CASE WHEN sd <= 1e-12 OR n < 3 THEN 0 ELSE (m3 - 3*mean*m2 + 2*mean**3) / sd**3 END AS skew,
  CASE WHEN sd <= 1e-12 OR n < 4 THEN 3 ELSE (m4 - 4*mean*m3 + 6*mean**2*m2 - 3*mean**4) / sd**4 END AS kurtosis FROM q)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


def weekly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, week, filled, signal, r, fwd): the filled weekly panel with its four-week momentum and returns."""
    panel = align.fill_grid(nation_values(spark, sf_dir, "week"))
    w = Window.partitionBy("series_id").orderBy("week")
    x = F.col("filled")
    return panel.select("series_id", "week", "filled", F.ln(x / F.lag(x, 4).over(w)).alias("signal"), (F.ln(x / F.lag(x).over(w)) / 50).alias("r"), (F.ln(F.lead(x).over(w) / x) / 50).alias("fwd"))


@query(DAILY + MOMENTS + """ SELECT series_id, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(positive_rate, 6) AS positive_rate, round(total, 6) AS total, round(least, 6) AS least, round(largest, 6) AS largest, round(sharpe, 6) AS sharpe, round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis FROM m""")
def return_moments(spark, sf_dir):
    return rounded(summary.return_moments(daily_series(spark, sf_dir)))


@query(DAILY + """, e AS (SELECT *, sum(ln(1 + r)) OVER (PARTITION BY series_id ORDER BY idx) AS lv FROM s WHERE r IS NOT NULL), k AS (SELECT *, greatest(max(lv) OVER (PARTITION BY series_id ORDER BY idx), 0) AS peak FROM e),
x AS (SELECT series_id, exp(sum(ln(1 + r))) - 1 AS total, count(*) AS n, max(1 - exp(lv - peak)) AS max_drawdown FROM k GROUP BY 1), y AS (SELECT *, (1 + total) ** (365.0 / n) - 1 AS annual FROM x)
SELECT series_id, round(total, 6) AS total, n, round(max_drawdown, 6) AS max_drawdown, round(annual, 6) AS annual, round(annual / nullif(max_drawdown, 0), 6) AS calmar FROM y""")
def compound_drawdown(spark, sf_dir):
    return rounded(summary.drawdown(daily_series(spark, sf_dir)))


@query(DAILY + """, x AS (SELECT series_id, r, row_number() OVER (PARTITION BY series_id ORDER BY r, idx) AS place, greatest(floor(count(*) OVER (PARTITION BY series_id) * 0.05), 1) AS k FROM s WHERE r IS NOT NULL)
SELECT series_id, round(avg(r), 6) AS cvar, count(*) AS k FROM x WHERE place <= k GROUP BY 1""")
def cvar_tail(spark, sf_dir):
    return rounded(summary.tail_mean(daily_series(spark, sf_dir)))


@query(DAILY + """ SELECT series_id, day, idx, round(CASE WHEN count(v) OVER a = 20 THEN avg(v) OVER a END, 2) AS sma, round(CASE WHEN count(v) OVER a = 20 THEN stddev_pop(v) OVER a END, 2) AS sd,
round(CASE WHEN count(v) OVER b = 60 THEN CASE WHEN stddev_samp(v) OVER b > 0 THEN (v - avg(v) OVER b) / stddev_samp(v) OVER b ELSE 0 END END, 5) AS z
FROM s WINDOW a AS (PARTITION BY series_id ORDER BY idx ROWS 19 PRECEDING), b AS (PARTITION BY series_id ORDER BY idx ROWS 59 PRECEDING)""")
def rolling_sma_std_z(spark, sf_dir):
    rows = rolling.rolling_statistics(daily_series(spark, sf_dir))
    return rows.select("series_id", "day", F.col("idx").cast("long").alias("idx"), F.round("sma", 2).alias("sma"), F.round("sd", 2).alias("sd"), F.round("z", 5).alias("z"))


@query(DAILY + """, x AS (SELECT *, CASE WHEN count(v) OVER a = 20 THEN CASE WHEN v > max(v) OVER a THEN 1 WHEN v < min(v) OVER a THEN -1 END END AS sig FROM s WINDOW a AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT series_id, day, idx, CAST(coalesce(last_value(sig IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY idx), 0) AS BIGINT) AS position FROM x""")
def donchian_state(spark, sf_dir):
    return rounded(rolling.donchian_state(daily_series(spark, sf_dir)).select("series_id", "day", "idx", "position"))


TSMOM = DAILY + """, x AS (SELECT *, CAST(coalesce(sign(lag(v, 1) OVER w / lag(v, 31) OVER w - 1), 0) AS INT) AS position FROM s WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
y AS (SELECT *, abs(position - coalesce(lag(position) OVER (PARTITION BY series_id ORDER BY idx), 0)) AS turnover, coalesce(position * r, 0) AS gross FROM x)"""


@query(TSMOM + " SELECT series_id, idx, CAST(position AS BIGINT) AS position, round(CAST(turnover AS DOUBLE), 6) AS turnover, round(gross, 6) + 0.0 AS gross, round(gross - turnover * 0.001, 6) + 0.0 AS net FROM y")
def tsmom_positions(spark, sf_dir):
    rows = backtest.charge(backtest.momentum(daily_series(spark, sf_dir)))
    return rounded(rows.select("series_id", "idx", "position", "turnover", "gross", "net"))


@query(DAILY + """, x AS (SELECT *, CAST(coalesce(sign(CASE WHEN count(v) OVER b = 20 THEN avg(v) OVER a - avg(v) OVER b END), 0) AS INT) AS position FROM s WINDOW a AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, abs(position - coalesce(lag(position) OVER (PARTITION BY series_id ORDER BY idx), 0)) AS turnover, coalesce(position * r, 0) AS gross FROM x)
SELECT series_id, round(sum(gross), 6) AS gross, round(sum(turnover), 6) AS turnover, round(sum(gross - turnover * 0.001), 6) AS net FROM y GROUP BY 1""")
def ma_cross_net(spark, sf_dir):
    rows = backtest.charge(backtest.crossover(daily_series(spark, sf_dir)))
    return rounded(rows.groupBy("series_id").agg(F.sum("gross").alias("gross"), F.sum("turnover").alias("turnover"), F.sum("net").alias("net")))


WEIGHTS = WEEKLY + """, k AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY signal DESC, series_id) AS up, row_number() OVER (PARTITION BY week ORDER BY signal, series_id DESC) AS dn, count(*) OVER (PARTITION BY week) AS n FROM p WHERE signal IS NOT NULL),
wt AS (SELECT *, CASE WHEN n < 10 THEN 0.0 WHEN up <= 5 THEN 0.2 WHEN dn <= 5 THEN -0.2 ELSE 0.0 END AS weight FROM k)"""


@query(WEIGHTS + " SELECT series_id, week, round(signal, 6) AS signal, round(CAST(weight AS DOUBLE), 6) AS weight FROM wt WHERE weight <> 0")
def xs_rank_topk(spark, sf_dir):
    rows = backtest.ranked_weights(weekly_panel(spark, sf_dir), "signal")
    return rounded(rows.filter("weight <> 0").select("series_id", "week", "signal", "weight"))


@query(WEIGHTS + """, t AS (SELECT *, abs(weight - coalesce(lag(weight) OVER (PARTITION BY series_id ORDER BY week), 0)) AS tv FROM wt), o AS (SELECT week, sum(CAST(weight AS DOUBLE) * coalesce(fwd, 0)) AS gross, CAST(sum(tv) AS DOUBLE) AS turnover FROM t GROUP BY 1)
SELECT week, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(gross - turnover * 0.0005, 6) AS net FROM o""")
def xs_momentum_weekly(spark, sf_dir):
    return rounded(backtest.portfolio(backtest.ranked_weights(weekly_panel(spark, sf_dir), "signal"), "fwd"))


@query(WEEKLY + " SELECT series_id, week, round(v, 2) AS v, round(filled, 2) AS filled FROM f")
def panel_grid_fill(spark, sf_dir):
    return rounded(align.fill_grid(nation_values(spark, sf_dir, "week")), 2)


@query("""WITH u AS (SELECT DISTINCT user_id FROM events), t AS (SELECT DISTINCT date_trunc('day', ts) + INTERVAL 12 HOUR AS probe FROM events), b AS (SELECT user_id, probe FROM u, t),
e AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS k FROM events) SELECT b.user_id, CAST(b.probe AS TIMESTAMP) AS probe, CAST(e.ts AS TIMESTAMP) AS ts, e.value FROM b ASOF LEFT JOIN (SELECT * FROM e WHERE k = 1) e ON b.user_id = e.user_id AND b.probe >= e.ts""")
def asof_last_event(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    days = events.select((F.date_trunc("day", "ts") + F.expr("INTERVAL 12 HOURS")).alias("probe")).distinct()
    # a probe a user and day: days are bounded by the calendar
    probes = events.select("user_id").distinct().join(F.broadcast(days), F.lit(True))
    return align.asof_last(probes, events, "user_id", "probe", "ts", "event_id", "value").select("user_id", F.col("probe").cast("timestamp_ntz").alias("probe"), F.col("ts").cast("timestamp_ntz").alias("ts"), "value")


BARS = """WITH b AS (SELECT event_type, to_timestamp(floor(epoch(ts) / {0}) * {0}) AT TIME ZONE 'UTC' AS bar, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2)"""


@query(BARS.format(900) + " SELECT event_type, bar, open, high, low, close, volume FROM b")
def bars_resample(spark, sf_dir):
    return event_bars(table(spark, sf_dir, "events"), 900).withColumn("bar", F.col("bar").cast("timestamp_ntz"))


@query(BARS.format(900) + """ SELECT event_type, bar, round(sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w, 6) AS vwap FROM b WINDOW w AS (PARTITION BY event_type, CAST(bar AS DATE) ORDER BY bar)""")
def session_vwap(spark, sf_dir):
    bars = event_bars(table(spark, sf_dir, "events"), 900)
    w = Window.partitionBy("event_type", F.to_date("bar")).orderBy("bar")
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return bars.select("event_type", F.col("bar").cast("timestamp_ntz").alias("bar"), F.round(F.sum(typical * F.col("volume")).over(w) / F.sum("volume").over(w), 6).alias("vwap"))


@query(BARS.format(600) + """, x AS (SELECT *, avg(volume) OVER w6 AS usual, count(*) OVER w6 AS n, lead(close) OVER w / close - 1 AS next FROM b WINDOW w AS (PARTITION BY event_type ORDER BY bar), w6 AS (PARTITION BY event_type ORDER BY bar ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT event_type, bar, volume, round(usual, 6) AS usual, round(next, 6) AS next FROM x WHERE n = 6 AND volume >= 2 * usual AND next IS NOT NULL""")
def volume_spike(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy("bar")
    bars = event_bars(table(spark, sf_dir, "events"), 600)
    six = w.rowsBetween(-6, -1)
    rows = bars.withColumns({"usual": F.avg("volume").over(six), "n": F.count(F.lit(1)).over(six), "next": F.try_divide(F.lead("close").over(w), F.col("close")) - 1})
    rows = rows.filter("n = 6 AND volume >= 2 * usual AND next IS NOT NULL")
    return rounded(rows.select("event_type", F.col("bar").cast("timestamp_ntz").alias("bar"), "volume", "usual", "next"))


@query(DAILY + " SELECT CAST(dayofweek(day) AS BIGINT) + 1 AS weekday, count(r) AS n, round(avg(r), 6) AS mean, round(sum(r), 6) AS total FROM s WHERE r IS NOT NULL GROUP BY 1")
def calendar_buckets(spark, sf_dir):
    rows = daily_series(spark, sf_dir).filter("r IS NOT NULL").groupBy(F.dayofweek("day").alias("weekday"))
    return rounded(rows.agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.sum("r").alias("total")))


@query(DAILY + """, x AS (SELECT *, CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w END AS vol FROM s WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS 19 PRECEDING)),
y AS (SELECT *, CASE WHEN count(vol) OVER w = 60 THEN median(vol) OVER w END AS mid FROM x WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS 59 PRECEDING)), z AS (SELECT series_id, CASE WHEN mid IS NULL THEN 'unknown' WHEN vol > mid THEN 'high' ELSE 'low' END AS regime FROM y)
SELECT series_id, regime, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY series_id), 6) AS share FROM z GROUP BY 1, 2""")
def regime_counts(spark, sf_dir):
    rows = rolling.volatility_regime(daily_series(spark, sf_dir)).groupBy("series_id", "regime").agg(F.count(F.lit(1)).alias("n"))
    return rounded(rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("series_id"))))


@query(DAILY + """, x AS (SELECT series_id, idx, CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w END AS vol, CASE WHEN count(r) OVER w = 20 THEN avg(r) OVER w END AS mean FROM s WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS 19 PRECEDING)),
y AS (SELECT *, median(vol) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mid FROM x),
z AS (SELECT series_id, (CASE WHEN mean > 0 THEN 'up' WHEN mean < 0 THEN 'down' ELSE 'flat' END) || (CASE WHEN vol > mid THEN '_high' ELSE '_low' END) AS regime FROM y)
SELECT series_id, regime, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY series_id), 6) AS share FROM z GROUP BY 1, 2""")
def expanding_regimes(spark, sf_dir):
    rows = rolling.expanding_regime(daily_series(spark, sf_dir)).groupBy("series_id", "regime").agg(F.count(F.lit(1)).alias("n"))
    return rounded(rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("series_id"))))


@query(WEEKLY + """, a AS (SELECT week, r AS x FROM p WHERE series_id = 0 AND r IS NOT NULL), l AS (SELECT unnest([-3, -2, -1, 0, 1, 2, 3]) AS lag)
SELECT b.series_id, CAST(lag AS BIGINT) AS lag, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(corr(a.x, b.r), 6) END AS corr FROM p b, l JOIN a ON a.week = b.week - CAST(lag * 7 AS INT) WHERE b.r IS NOT NULL GROUP BY 1, 2""")
def lead_lag_corr(spark, sf_dir):
    panel = weekly_panel(spark, sf_dir).select("series_id", "week", F.col("r").alias("x")).filter("x IS NOT NULL")
    return rounded(align.lagged_correlations(panel.filter("series_id = 0"), panel, range(-3, 4)))


@query("""WITH x AS (SELECT event_type AS state, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events), n AS (SELECT state, next, count(*) AS n FROM x WHERE next IS NOT NULL GROUP BY 1, 2) SELECT state, next, n, round(n / sum(n) OVER (PARTITION BY state), 6) AS share FROM n""")
def markov_transitions(spark, sf_dir):
    return rounded(summary.transitions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type"))


@query(DAILY + """, m AS (SELECT series_id, count(*) AS n, avg(CASE WHEN r IS NULL THEN 1.0 ELSE 0.0 END) AS missing, median(r) AS med FROM s GROUP BY 1), q AS (SELECT series_id, median(abs(r - med)) AS mad FROM s JOIN m USING (series_id) GROUP BY 1),
o AS (SELECT series_id, n, missing, med, mad, count(*) FILTER (mad > 0 AND abs(r - med) / nullif(mad, 0) > 8) AS outliers FROM s JOIN m USING (series_id) JOIN q USING (series_id) GROUP BY ALL)
SELECT series_id, n, round(missing, 6) AS missing, round(med, 6) AS median, round(mad, 6) AS mad, outliers, CASE WHEN missing >= 0.2 THEN 'FAIL' WHEN missing >= 0.01 OR outliers > 0 THEN 'WARN' ELSE 'PASS' END AS grade FROM o""")
def data_quality_grade(spark, sf_dir):
    return rounded(summary.series_quality(daily_series(spark, sf_dir)))


@query("""WITH u AS (SELECT user_id, avg(value) FILTER (ts < TIMESTAMP '2024-01-16') AS a, avg(value) FILTER (ts >= TIMESTAMP '2024-01-16') AS b, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS na, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS nb FROM events WHERE event_type IN ('purchase', 'click') GROUP BY 1),
q AS (SELECT *, ntile(4) OVER (ORDER BY a, user_id) AS quartile FROM u WHERE na >= 3 AND nb >= 1) SELECT CAST(quartile AS BIGINT) AS quartile, count(*) AS n, round(avg(a), 6) AS before, round(avg(b), 6) AS after, round(corr(a, b), 6) AS corr FROM q GROUP BY 1""")
def wallet_cohort(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "click"))
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    users = rows.groupBy("user_id").agg(F.avg(F.when(early, F.col("value"))).alias("a"), F.avg(F.when(~early, F.col("value"))).alias("b"), F.count_if(early).alias("na"), F.count_if(~early).alias("nb"))
    users = users.filter("na >= 3 AND nb >= 1").withColumn("quartile", F.ntile(4).over(Window.orderBy("a", "user_id")))
    return rounded(users.groupBy("quartile").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("before"), F.avg("b").alias("after"), F.corr("a", "b").alias("corr")))


@query("""WITH x AS (SELECT c_nationkey, c_custkey, abs(sum(o_totalprice)) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, count(*) AS parts, round(max(x) / sum(x), 6) AS largest_share, round(sum(x*x) / (sum(x) * sum(x)), 6) AS hhi FROM x GROUP BY 1""")
def hhi_concentration(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    rows = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return rounded(summary.concentration(rows, "c_nationkey", "c_custkey", "o_totalprice"))


TRIALS = [1, 5, 24, 72, 256]


@query(DAILY + MOMENTS + f""", t(trials, luck) AS (VALUES {", ".join(f"({n}, {expected_max(n)!r})" for n in TRIALS)}), e AS (SELECT *, sqrt(greatest(1 - skew*sharpe + (kurtosis - 1)/4*sharpe*sharpe, 1e-12) / (n - 1)) AS se FROM m WHERE n > 1)
SELECT series_id, CAST(trials AS BIGINT) AS trials, round(se, 6) AS se, round({normal_cdf_sql("(sharpe / se)")}, 6) AS psr, round({normal_cdf_sql("((sharpe - se * luck) / se)")}, 6) AS dsr FROM e, t""")
def dsr_by_trials(spark, sf_dir):
    rows = inference.deflated_sharpe(summary.return_moments(daily_series(spark, sf_dir)), TRIALS)
    return rounded(rows.select("series_id", "trials", "se", "psr", "dsr"))


@query(DAILY + MOMENTS + f""", a AS (SELECT series_id, 2 * (1 - {normal_cdf_sql("abs(sharpe * sqrt(n))")}) AS p, count(*) OVER () AS m FROM m), b AS (SELECT *, row_number() OVER (ORDER BY p, series_id) AS place FROM a),
c AS (SELECT *, p * (m - place + 1) AS h, p * m * list_sum(list_transform(range(1, m + 1), lambda i: 1 / i)) / place AS y FROM b)
SELECT series_id, round(p, 6) AS p, place, round(least(p * m, 1), 6) AS bonferroni, round(least(max(h) OVER (ORDER BY p, series_id), 1), 6) AS holm, round(least(min(y) OVER (ORDER BY p DESC, series_id DESC), 1), 6) AS bhy,
  round(least(h, 1), 6) AS holm_step, round(least(y, 1), 6) AS bhy_step, NOT EXISTS (SELECT 1 FROM c o WHERE o.place <= c.place AND o.p > 0.05 / (o.m - o.place + 1)) AS holm_significant, y <= 0.05 AS bhy_significant FROM c""")
def haircut_panel(spark, sf_dir):
    rows = inference.sharpe_haircuts(summary.return_moments(daily_series(spark, sf_dir)))
    return rounded(rows.select("series_id", "p", "place", "bonferroni", "holm", "bhy", "holm_step", "bhy_step", "holm_significant", "bhy_significant"))


@query(DAILY + """, z AS (SELECT series_id, least((idx - 1) * 8 // count(*) OVER (PARTITION BY series_id), 7) AS fold, r FROM s), sc AS (SELECT series_id, fold, count(r) AS n, sum(r) AS total FROM z GROUP BY 1, 2),
b AS (SELECT i FROM range(256) t(i) WHERE bit_count(i::UTINYINT) = 4), sp AS (SELECT i, fold, (i >> (7 - fold)) & 1 = 1 AS train, 69 - row_number() OVER (PARTITION BY fold ORDER BY i) + 1 AS split FROM b, range(8) f(fold)),
e AS (SELECT split, series_id, sum(total) FILTER (train) / sum(n) FILTER (train) AS ins, sum(total) FILTER (NOT train) / sum(n) FILTER (NOT train) AS outs FROM sc JOIN sp USING (fold) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY outs, series_id) AS rk, row_number() OVER (PARTITION BY split ORDER BY ins DESC, series_id) AS f, count(*) OVER (PARTITION BY split) AS m FROM e)
SELECT split, series_id, round(rk / (m + 1), 6) AS share, round(ln((rk / (m + 1)) / (1 - rk / (m + 1))), 6) AS logit FROM k WHERE f = 1""")
def pbo_cscv(spark, sf_dir):
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    fold = F.least(F.floor((F.col("idx") - 1) * 8 / n), F.lit(7)).cast("int")
    scores = daily_series(spark, sf_dir).withColumn("fold", fold).groupBy("series_id", "fold").agg(F.count("r").alias("n"), F.sum("r").alias("total"))
    return rounded(inference.overfitting(scores))


@query("""WITH x AS (SELECT l_discount * 10 AS p, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS won FROM lineitem) SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bucket, count(*) AS n, round(avg(p), 6) AS price, round(avg(won), 6) AS rate, round(avg((p - won) * (p - won)), 6) AS brier FROM x GROUP BY 1""")
def calibration_buckets(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("p"), (F.col("l_returnflag") == "R").cast("double").alias("won"))
    return rounded(inference.calibration(rows, "p", "won"))


@query("""WITH RECURSIVE d AS (SELECT CAST(c_nationkey AS BIGINT) AS series_id, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
s AS MATERIALIZED (SELECT series_id, v, row_number() OVER w AS idx, v - lag(v) OVER w AS c FROM d WINDOW w AS (PARTITION BY series_id ORDER BY day)),
e AS (SELECT series_id, idx, v, v AS ema, CAST(NULL AS DOUBLE) AS up, CAST(NULL AS DOUBLE) AS dn FROM s WHERE idx = 1 UNION ALL
SELECT s.series_id, s.idx, s.v, e.ema + 2.0 / 15 * (s.v - e.ema), CASE WHEN e.up IS NULL THEN greatest(c, 0) ELSE e.up + (greatest(c, 0) - e.up) / 14 END, CASE WHEN e.dn IS NULL THEN greatest(-c, 0) ELSE e.dn + (greatest(-c, 0) - e.dn) / 14 END FROM e JOIN s ON s.series_id = e.series_id AND s.idx = e.idx + 1)
SELECT series_id, idx, round(ema, 2) AS ema, round(CASE WHEN idx > 14 THEN CASE WHEN dn > 0 THEN 100 - 100 / (1 + up / dn) ELSE 100 END END, 5) AS rsi FROM e""")
def ema_rsi(spark, sf_dir):
    rows = rolling.recurrent(daily_series(spark, sf_dir))
    return rows.select("series_id", F.col("idx").cast("long").alias("idx"), F.round("ema", 2).alias("ema"), F.round(F.nanvl("rsi", F.lit(None)), 5).alias("rsi"))
