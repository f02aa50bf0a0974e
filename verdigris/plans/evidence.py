"""Queries of purged cross-validation, haircut Sharpe ratios and pairs, and the SQL that they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normal import expected_max, normal_cdf_sql, normal_quantile_sql
from ..operators import inference, pairs, purged, summary
from ..sources.tables import daily_series
from .edges import GRID, grid
from .queries import DAILY, MOMENTS, WEEKLY, query, rounded, weekly_panel

PATHS = GRID + """, z AS (SELECT series_id, param, net, i - min(i) OVER v AS p, max(i) OVER v - min(i) OVER v + 1 AS n FROM m WINDOW v AS (PARTITION BY series_id)), z2 AS (SELECT *, p * 6 // n AS fold FROM z),
fo AS (SELECT *, p - min(p) OVER v AS off, max(p) OVER v - p AS rest FROM z2 WINDOW v AS (PARTITION BY series_id, fold)), sp AS (SELECT row_number() OVER (ORDER BY a, b) AS split, a, b FROM range(6) x(a), range(6) y(b) WHERE a < b),
tr AS (SELECT series_id, split, param, round(CASE WHEN stddev_samp(net) > 1e-12 THEN avg(net) / stddev_samp(net) ELSE 0 END, 9) AS sharpe FROM fo JOIN sp ON fold NOT IN (a, b) AND NOT (off < 6 AND fold - 1 IN (a, b)) AND NOT (rest < 1 AND fold + 1 IN (a, b)) GROUP BY 1, 2, 3),
ch AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY series_id, split ORDER BY sharpe DESC, param) = 1), pl AS (SELECT split, fold, row_number() OVER (PARTITION BY fold ORDER BY split) - 1 AS path FROM (SELECT split, a AS fold FROM sp UNION ALL SELECT split, b FROM sp)),
o AS (SELECT ch.series_id, path, net FROM pl JOIN ch USING (split) JOIN fo ON fo.series_id = ch.series_id AND fo.param = ch.param AND fo.fold = pl.fold),
pa AS (SELECT series_id, path, count(net) AS n, CASE WHEN stddev_samp(net) > 1e-12 THEN avg(net) / stddev_samp(net) ELSE 0 END AS sharpe, sum(ln(1 + net)) AS gain, exp(sum(ln(1 + net))) - 1 AS total FROM o GROUP BY 1, 2)"""


def paths_of(spark, sf_dir):
    return purged.cpcv_paths(grid(spark, sf_dir), "series_id")


@query(PATHS + " SELECT series_id, path, n, round(sharpe, 6) + 0.0 AS sharpe, round(total, 6) + 0.0 AS total FROM pa")
def cpcv_paths(spark, sf_dir):
    return rounded(paths_of(spark, sf_dir).select("series_id", "path", "n", "sharpe", "total"))


@query(PATHS + f""", su AS (SELECT series_id, count(*) AS paths, median(sharpe) AS median_sharpe, min(sharpe) AS worst_sharpe, max(sharpe) AS best_sharpe, coalesce(stddev_samp(sharpe), 0) AS dispersion, avg(CASE WHEN total > 0 THEN 1.0 ELSE 0 END) AS positive, median(total) AS median_total, min(total) AS worst_total FROM pa GROUP BY 1),
po AS (SELECT series_id, count(net) AS n, avg(net) AS mean, stddev_samp(net) AS sd, avg(net*net) AS m2, avg(net*net*net) AS m3, avg(net*net*net*net) AS m4 FROM o GROUP BY 1), mo AS (SELECT series_id, n, mean / sd AS sr, (m3 - 3*mean*m2 + 2*mean**3) / sd**3 AS skew, (m4 - 4*mean*m3 + 6*mean**2*m2 - 3*mean**4) / sd**4 AS kurt FROM po),
se AS (SELECT *, sqrt(greatest(1 - skew*sr + (kurt - 1)/4*sr*sr, 1e-12) / (n - 1)) AS se FROM mo)
SELECT series_id, paths, n, {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("median_sharpe", "worst_sharpe", "best_sharpe", "dispersion", "positive", "median_total", "worst_total"))}, round(median_sharpe * 0.55 + worst_sharpe * 0.45 - dispersion * 0.5 + positive * 0.3, 6) + 0.0 AS score, round({normal_cdf_sql(f"((sr - se * {expected_max(4)!r}) / se)")}, 6) AS dsr FROM su JOIN se USING (series_id)""")
def cpcv_scores(spark, sf_dir):
    rows = inference.deflated_sharpe(purged.path_scores(paths_of(spark, sf_dir), "series_id"), [4])
    return rounded(rows.select("series_id", "paths", "n", "median_sharpe", "worst_sharpe", "best_sharpe", "dispersion", "positive", "median_total", "worst_total", "score", "dsr"))


def odds_sql(scores: str, kind: str, folds: int, size: int) -> str:
    """Common table expressions that end in ``kind``, for log growth by (s, fold, g)."""
    return f"""{kind}_e AS (SELECT mask, s, round(coalesce(sum(g) FILTER ((mask >> fold) & 1 = 1), 0), 9) AS ins, round(coalesce(sum(g) FILTER ((mask >> fold) & 1 = 0), 0), 9) AS outs FROM {scores}, (SELECT range AS mask FROM range({1 << folds}) WHERE bit_count(range) = {size}) GROUP BY 1, 2),
{kind}_c AS (SELECT * FROM {kind}_e QUALIFY row_number() OVER (PARTITION BY mask ORDER BY ins DESC, s) = 1), {kind}_p AS (SELECT mask, count(*) AS m, count(*) FILTER (e.outs > c.outs OR e.outs = c.outs AND e.s < c.s) AS better FROM {kind}_e e JOIN {kind}_c c USING (mask) GROUP BY 1),
{kind}_l AS (SELECT m, least(greatest(1 - better / (m - 1), 1e-12), 1 - 1e-12) AS q FROM {kind}_p), {kind} AS (SELECT '{kind}' AS kind, max(m) AS strategies, {folds}::BIGINT AS folds, count(*) AS splits, round(avg(CASE WHEN q < 0.5 THEN 1.0 ELSE 0 END), 6) AS pbo, round(avg(ln(q / (1 - q))), 4) AS mean_logit, round(median(ln(q / (1 - q))), 4) AS median_logit FROM {kind}_l)"""


@query(PATHS + f""", g1 AS (SELECT series_id AS s, path AS fold, gain AS g FROM pa), g2 AS (SELECT series_id AS s, least((idx - 1) * 8 // count(*) OVER (PARTITION BY series_id), 7) AS fold, ln(1 + r) AS g FROM s),
{odds_sql("g1", "paths", 5, 3)}, {odds_sql("g2", "folds", 8, 4)} SELECT * FROM paths UNION ALL SELECT * FROM folds""")
def overfitting_odds(spark, sf_dir):
    of_paths = purged.overfit_odds(paths_of(spark, sf_dir), "series_id", "path", "gain", 5)
    series = daily_series(spark, sf_dir)
    sizes = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"))
    fold = F.floor((F.col("idx") - 1) * 8 / F.col("rows")).cast("int")
    sums = series.join(sizes, "series_id").groupBy("series_id", fold.alias("fold")).agg(F.sum(F.ln(1 + F.col("r"))).alias("gain"))
    of_folds = purged.overfit_odds(sums, "series_id", "fold", "gain", 8)
    both = of_paths.withColumn("kind", F.lit("paths")).unionByName(of_folds.withColumn("kind", F.lit("folds")))
    return rounded(both.withColumns({c: F.round(c, 4) for c in ("mean_logit", "median_logit")}))


def cut_sql(name: str, p: str) -> str:
    left = f"(CASE WHEN n < 2 OR {p} >= 1 THEN 0 ELSE sign(sharpe) * {normal_quantile_sql(f'(1 - {p} / 2)')} / sqrt(n) END)"
    return f"round({left}, 6) + 0.0 AS {name}_sharpe, round(CASE WHEN abs(sharpe) > 1e-9 THEN least(greatest(1 - {left} / sharpe, 0), 1) ELSE 0 END, 6) + 0.0 AS {name}_cut"


@query(DAILY + MOMENTS + f""", a AS (SELECT series_id, n, sharpe, 2 * (1 - {normal_cdf_sql("abs(sharpe * sqrt(n))")}) AS p, count(*) OVER () AS m FROM m), b AS (SELECT *, row_number() OVER (ORDER BY p, series_id) AS place FROM a),
c AS (SELECT *, least(p * m, 1) AS pb, least(p * (m - place + 1), 1) AS ph, least(p * m * list_sum(list_transform(range(1, m + 1), lambda i: 1 / i)) / place, 1) AS py FROM b)
SELECT series_id, n, round(sharpe, 6) AS sharpe, {cut_sql("bonferroni", "pb")}, {cut_sql("holm", "ph")}, {cut_sql("bhy", "py")} FROM c""")
def haircut_sharpes(spark, sf_dir):
    rows = inference.haircut_sharpes(inference.sharpe_haircuts(summary.return_moments(daily_series(spark, sf_dir))))
    return rounded(rows.select("series_id", "n", "sharpe", *[f"{c}_{k}" for c in ("bonferroni", "holm", "bhy") for k in ("sharpe", "cut")]))


def log_panel(spark, sf_dir):
    return weekly_panel(spark, sf_dir).select("series_id", "week", F.ln("filled").alias("x"))


def related(spark, sf_dir):
    """The pairs that the screen keeps: correlations of 0.1 or more either way."""
    panel = log_panel(spark, sf_dir)
    return panel, pairs.pair_regressions(panel, "series_id", "week", "x", F.year("week")).filter("abs(corr) >= 0.1")


@query(WEEKLY + """, x AS (SELECT series_id, week, ln(filled) AS x FROM f), g0 AS (SELECT l.series_id AS a, k.series_id AS b, count(*) AS n, regr_slope(l.x, k.x) AS beta, regr_intercept(l.x, k.x) AS alpha, corr(l.x, k.x) AS corr FROM x l JOIN x k ON l.week = k.week AND l.series_id < k.series_id GROUP BY 1, 2),
h AS (SELECT * FROM g0 WHERE abs(corr) >= 0.1), e AS (SELECT a, b, l.week, l.x - alpha - beta * k.x AS y FROM h JOIN x l ON l.series_id = a JOIN x k ON k.series_id = b AND k.week = l.week),
w AS (SELECT *, lag(y) OVER o AS l1, lag(y, 2) OVER o AS l2 FROM e WINDOW o AS (PARTITION BY a, b ORDER BY week)), t AS (SELECT a, b, y - l1 AS dy, l1, l1 - l2 AS dl FROM w WHERE l2 IS NOT NULL),
u AS (SELECT a, b, count(*) AS m, sum(l1*l1) AS ll, sum(l1*dl) AS ld, sum(dl*dl) AS dd, sum(l1*dy) AS ly, sum(dl*dy) AS dy FROM t GROUP BY 1, 2), v AS (SELECT *, ll*dd - ld*ld AS det, (dd*ly - ld*dy) / (ll*dd - ld*ld) AS rho, (ll*dy - ld*ly) / (ll*dd - ld*ld) AS phi FROM u),
ss AS (SELECT t.a, t.b, sum((t.dy - rho * l1 - phi * dl) ** 2) AS sse FROM t JOIN v ON v.a = t.a AND v.b = t.b GROUP BY 1, 2), ad AS (SELECT v.a, v.b, rho / sqrt(sse / (m - 2) * dd / det) AS adf FROM v JOIN ss ON v.a = ss.a AND v.b = ss.b),
ou AS (SELECT a, b, regr_slope(y, l1) AS s FROM w WHERE l1 IS NOT NULL GROUP BY 1, 2)
SELECT h.a, h.b, n, round(beta, 5) AS beta, round(alpha, 4) AS alpha, round(corr, 5) AS corr, round(adf, 4) AS adf, round(CASE WHEN s > 0 AND s < 1 THEN ln(2) / -ln(s) END, 4) AS half_life FROM h JOIN ad ON ad.a = h.a AND ad.b = h.b JOIN ou ON ou.a = h.a AND ou.b = h.b""")
def pair_stationarity(spark, sf_dir):
    panel, kept = related(spark, sf_dir)
    rows = pairs.pair_rows(panel, kept, "series_id", "week", "x").withColumn("e", F.col("xa") - F.col("alpha") - F.col("beta") * F.col("xb"))
    found = kept.join(pairs.stationarity(rows, ["a", "b"], "at", "e"), ["a", "b"])
    digits = {"beta": 5, "alpha": 4, "corr": 5, "adf": 4, "half_life": 4}
    return found.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "n", *[(F.round(c, d) + F.lit(0.0)).alias(c) for c, d in digits.items()])


@query()
def spread_trades(spark, sf_dir):
    panel, kept = related(spark, sf_dir)
    trades = pairs.spread_trades(pairs.pair_rows(panel, kept, "series_id", "week", "x"))
    out = trades.groupBy("pair").agg(F.count(F.lit(1)).alias("rows"), F.count("closed").alias("trades"), F.avg("closed").alias("hold"), F.sum("net").alias("net"))
    return rounded(out.select("pair.a", "pair.b", "rows", "trades", "hold", "net"))
