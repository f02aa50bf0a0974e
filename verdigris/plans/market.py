"""Queries of indicators, forward joins and set operations, and the SQL that they are compared with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import align, indicators, sets
from ..sources.tables import daily_series, event_bars, nation_values, table
from .queries import BARS, DAILY, query, rounded


def bars_of(spark, sf_dir):
    return event_bars(table(spark, sf_dir, "events"), 600).withColumn("bar", F.col("bar").cast("timestamp_ntz"))



@query(DAILY + """ SELECT series_id, idx, round(avg(v) OVER w, 6) AS partial_mean, round(CASE WHEN count(v) OVER w = 20 THEN avg(v) OVER w END, 6) AS full_mean, round(CASE WHEN count(v) OVER w = 20 THEN max(v) OVER w END, 2) AS highest,
round(CASE WHEN count(v) OVER w = 20 THEN min(v) OVER w END, 2) AS lowest, round(CASE WHEN idx > 1 AND stddev_pop(v) OVER w > 1e-12 THEN (v - avg(v) OVER w) / stddev_pop(v) OVER w ELSE 0 END, 4) + 0.0 AS z FROM s WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS 19 PRECEDING)""")
def moving_statistics(spark, sf_dir):
    rows = indicators.moving_statistics(daily_series(spark, sf_dir))
    return rows.select("series_id", F.col("idx").cast("long").alias("idx"), *[F.round(c, d).alias(c) for c, d in (("partial_mean", 6), ("full_mean", 6), ("highest", 2), ("lowest", 2))], (F.round("z", 4) + F.lit(0.0)).alias("z"))


@query(DAILY + """, x AS (SELECT series_id, idx, v, count(v) OVER w AS n, avg(v) OVER w AS mid, stddev_pop(v) OVER w AS spread, max(v) OVER w AS top, min(v) OVER w AS bottom FROM s WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT series_id, idx, round(mid + 2 * spread, 2) AS upper, round(mid - 2 * spread, 2) AS lower, round(top, 2) AS top, round(bottom, 2) AS bottom, CASE WHEN v > top THEN 1 WHEN v < bottom THEN -1 ELSE 0 END AS entry FROM x WHERE n = 20""")
def prior_bands(spark, sf_dir):
    rows = indicators.prior_bands(daily_series(spark, sf_dir)).filter("mid IS NOT NULL")
    return rows.select("series_id", F.col("idx").cast("long").alias("idx"), *[F.round(c, 2).alias(c) for c in ("upper", "lower", "top", "bottom")], "entry")


@query(BARS.format(600) + """, p AS (SELECT event_type, bar, lag(high) OVER w AS h, lag(low) OVER w AS l, lag(close) OVER w AS c FROM b WINDOW w AS (PARTITION BY event_type ORDER BY bar)), q AS (SELECT *, (h + l + c) / 3 AS pp FROM p)
SELECT event_type, bar, round(pp, 6) AS pp, round(2 * pp - l, 6) AS r1, round(2 * pp - h, 6) AS s1, round(pp + h - l, 6) AS r2, round(pp - h + l, 6) AS s2 FROM q""")
def floor_pivots(spark, sf_dir):
    return rounded(indicators.floor_pivots(bars_of(spark, sf_dir), "event_type", "bar").select("event_type", "bar", "pp", "r1", "s1", "r2", "s2"))


@query(DAILY + """, x AS (SELECT series_id, idx, CASE WHEN count(v) OVER w = 14 THEN CASE WHEN max(v) OVER w > min(v) OVER w THEN 100 * (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) ELSE 50 END END AS raw_k FROM s WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS 13 PRECEDING))
SELECT series_id, idx, round(raw_k, 4) AS raw_k, round(CASE WHEN count(raw_k) OVER w = 3 THEN avg(raw_k) OVER w END, 4) AS k FROM x WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS 2 PRECEDING)""")
def stochastic_k(spark, sf_dir):
    return indicators.stochastic(daily_series(spark, sf_dir)).select("series_id", F.col("idx").cast("long").alias("idx"), F.round("raw_k", 4).alias("raw_k"), F.round("k", 4).alias("k"))


@query(BARS.format(600) + """, t AS (SELECT event_type, bar, (high + low + close) / 3 AS tp FROM b), m AS (SELECT *, count(tp) OVER w AS n, avg(tp) OVER w AS mean, list(tp) OVER w AS held FROM t WINDOW w AS (PARTITION BY event_type ORDER BY bar ROWS 19 PRECEDING)),
d AS (SELECT *, list_sum(list_transform(held, lambda x: abs(x - mean))) / 20 AS mad FROM m WHERE n = 20) SELECT event_type, bar, round(CASE WHEN mad > 1e-12 THEN (tp - mean) / (0.015 * mad) ELSE 0 END, 4) AS cci FROM d""")
def channel_index(spark, sf_dir):
    return indicators.channel_index(bars_of(spark, sf_dir), "event_type", "bar").filter("cci IS NOT NULL").select("event_type", "bar", F.round("cci", 4).alias("cci"))


@query(BARS.format(600) + """, l AS (SELECT *, lag(close) OVER (PARTITION BY event_type ORDER BY bar) AS last FROM b), t AS (SELECT event_type, bar, high, low, CASE WHEN last IS NOT NULL THEN greatest(high - low, abs(high - last), abs(low - last)) END AS tr FROM l)
SELECT event_type, bar, round(tr, 6) AS tr, round(coalesce(avg(tr) OVER w, high - low), 6) AS atr FROM t WINDOW w AS (PARTITION BY event_type ORDER BY bar ROWS 13 PRECEDING)""")
def true_range(spark, sf_dir):
    return rounded(indicators.true_range(bars_of(spark, sf_dir), "event_type", "bar").select("event_type", "bar", "tr", "atr"))


@query(DAILY + " SELECT series_id, count(r) AS n, round(CASE WHEN coalesce(stddev_samp(r), 0) > 1e-12 THEN avg(r) / stddev_samp(r) * sqrt(365) ELSE 0 END, 6) AS sharpe FROM s GROUP BY 1")
def annual_sharpe(spark, sf_dir):
    return rounded(indicators.annual_sharpe(daily_series(spark, sf_dir), "series_id"))


@query(DAILY + """, x AS (SELECT series_id, idx, r, lead(r) OVER (PARTITION BY series_id ORDER BY idx) AS next FROM s), k AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY r, idx) AS a, row_number() OVER (PARTITION BY series_id ORDER BY next, idx) AS b FROM x WHERE r IS NOT NULL AND next IS NOT NULL)
SELECT series_id, count(*) AS n, round(corr(a, b), 6) AS spearman FROM k GROUP BY 1""")
def ordinal_spearman(spark, sf_dir):
    rows = daily_series(spark, sf_dir).withColumn("next", F.lead("r").over(Window.partitionBy("series_id").orderBy("idx")))
    return rounded(indicators.ordinal_spearman(rows, "series_id", "r", "next", "idx"))


@query(DAILY + """, x AS (SELECT series_id, r, lead(r) OVER (PARTITION BY series_id ORDER BY idx) AS next FROM s), g AS (SELECT series_id, regr_count(next, r) AS n, regr_slope(next, r) AS b, regr_sxx(next, r) AS sxx, regr_syy(next, r) AS syy FROM x GROUP BY 1),
e AS (SELECT *, sqrt(greatest(syy - b * b * sxx, 0) / (n - 2) / sxx) AS se FROM g) SELECT series_id, CAST(n AS BIGINT) AS n, round(CASE WHEN n >= 10 AND sxx > 0 THEN b END, 6) AS beta, round(CASE WHEN n >= 10 AND sxx > 0 AND se > 0 THEN b / se END, 6) AS t FROM e""")
def slope_t(spark, sf_dir):
    rows = daily_series(spark, sf_dir).withColumn("next", F.lead("r").over(Window.partitionBy("series_id").orderBy("idx")))
    return rounded(indicators.slope_t(rows, "series_id", "r", "next"))


@query("""WITH d AS (SELECT CAST(c_nationkey AS BIGINT) AS series_id, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), w AS (SELECT series_id, CAST(date_trunc('week', day) AS DATE) AS week, arg_max(v, day) AS close FROM d GROUP BY 1, 2)
SELECT series_id, week, round(close, 2) AS close, round(close / max(close) OVER (PARTITION BY series_id ORDER BY week RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 7 DAY PRECEDING) - 1, 6) AS change FROM w""")
def weekly_closes(spark, sf_dir):
    rows = indicators.week_closes(nation_values(spark, sf_dir, "day"), "series_id", "day", "v")
    return rows.select("series_id", "week", F.round("close", 2).alias("close"), F.round("change", 6).alias("change"))


@query(DAILY + ", y AS (SELECT series_id, CAST(year(day) AS BIGINT) AS year, count(r) AS n, avg(r) * 365 AS apr FROM s WHERE r IS NOT NULL GROUP BY 1, 2) SELECT year, count(*) AS series, CAST(sum(n) AS BIGINT) AS n, round(avg(apr), 6) AS apr FROM y GROUP BY 1")
def yearly_decay(spark, sf_dir):
    return rounded(indicators.yearly_rates(daily_series(spark, sf_dir), "series_id", "day", "r"))


@query("""SELECT CAST(ts AS DATE) AS day, count(*) AS trades, round(avg(value), 6) AS mean, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM events WHERE event_type = 'purchase' GROUP BY 1""")
def trades_by_day(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type = 'purchase'").groupBy(F.to_date("ts").alias("day"))
    return rounded(rows.agg(F.count(F.lit(1)).alias("trades"), F.avg("value").alias("mean"), F.avg((F.col("value") > 50).cast("double")).alias("win_rate")))


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), q AS (SELECT user_id, ts, min(event_id) AS first, min_by(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT p.event_id, q.first AS next_id, q.value AS next_value FROM p ASOF LEFT JOIN q ON p.user_id = q.user_id AND q.ts >= p.ts""")
def asof_next_event(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return align.asof_next(events.filter("event_type = 'click'").select("event_id", "user_id", "ts"), events.filter("event_type = 'purchase'"), "user_id", "ts", "event_id", "value")


@query(DAILY + """, e AS (SELECT series_id, idx, 1 AS layer FROM (SELECT *, max(v) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS top FROM s) WHERE v > top AND idx > 20
UNION ALL SELECT series_id, idx, 2 FROM (SELECT *, max(v) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS top FROM s) WHERE v > top AND idx > 60) SELECT series_id, idx, min(layer) AS layer, count(*) AS layers FROM e GROUP BY 1, 2""")
def signal_union(spark, sf_dir):
    series = daily_series(spark, sf_dir)
    layers = [indicators.prior_bands(series, n).filter("entry = 1").select("series_id", F.col("idx").cast("long").alias("idx"), F.lit(k).alias("layer")) for k, n in ((1, 20), (2, 60))]
    return sets.first_layer_union(layers[0].union(layers[1]), ["series_id", "idx"], "layer")


@query("""WITH p AS (SELECT event_type, CAST(ts AS DATE) AS day, min(event_id) AS place FROM events GROUP BY 1, 2), n AS (SELECT count(DISTINCT event_type) AS n, min(event_type) AS leader FROM events), a AS (SELECT day FROM p GROUP BY 1 HAVING count(*) = (SELECT n FROM n))
SELECT day, place FROM a JOIN p USING (day) WHERE event_type = (SELECT leader FROM n)""")
def shared_days(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "event_id")
    return sets.in_all(rows, "event_type", "day", "event_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, min(event_id) AS first_seen, count(*) AS rows FROM events GROUP BY 1")
def last_run(spark, sf_dir):
    return sets.last_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("SELECT l_returnflag AS family, count(DISTINCT {'a': l_linestatus, 'b': l_suppkey}) AS trials, count(*) AS runs FROM lineitem GROUP BY 1")
def honest_trials(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("family"), "l_linestatus", "l_suppkey")
    return sets.distinct_trials(rows, "family", ["l_linestatus", "l_suppkey"])


@query("""WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events), used AS (SELECT DISTINCT user_id, day FROM e WHERE day < DATE '2024-01-10'), f AS (SELECT * FROM e WHERE (user_id, day) NOT IN (SELECT (user_id, day) FROM used))
SELECT user_id, day, min(event_id) AS event_id FROM f GROUP BY 1, 2""")
def holdout_once(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("day"))
    return sets.consume_once(rows, rows.filter("day < DATE '2024-01-10'"), ["user_id", "day"], "event_id").select("user_id", "day", "event_id")
