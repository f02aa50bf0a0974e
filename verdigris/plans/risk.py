"""Queries of rolling covariances and the portfolios weighted by them, and the SQL that they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import covariance
from .queries import WEEKLY, query, rounded, weekly_panel

COV = WEEKLY + """, cv AS (SELECT l.week, l.series_id AS a, k.series_id AS b, CASE WHEN count(l.r + k.r) OVER w = 26 THEN covar_samp(l.r, k.r) OVER w END * CASE WHEN l.series_id = k.series_id THEN 1 ELSE 0.9 END AS cov
FROM p l JOIN p k ON l.week = k.week AND l.series_id <= k.series_id WINDOW w AS (PARTITION BY l.series_id, k.series_id ORDER BY l.week ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING))"""


def covariances(spark, sf_dir):
    panel = weekly_panel(spark, sf_dir)
    return panel, covariance.trailing_covariances(panel, "series_id", "week", "r")


@query(COV + " SELECT week, a, b, round(cov * 1e4, 6) + 0.0 AS cov FROM cv WHERE cov IS NOT NULL")
def trailing_covariances(spark, sf_dir):
    rows = covariances(spark, sf_dir)[1]
    return rounded(rows.select(F.col("at").alias("week"), "a", "b", (F.col("cov") * 1e4).alias("cov")))


@query(COV + """, iv AS (SELECT week, a, 1 / greatest(sqrt(cov), 1e-9) AS i FROM cv WHERE a = b AND cov IS NOT NULL), wt AS (SELECT week, a, i / sum(i) OVER (PARTITION BY week) AS weight FROM iv), mv AS (SELECT *, abs(weight - coalesce(lag(weight) OVER (PARTITION BY a ORDER BY week), 0)) AS moved FROM wt)
SELECT mv.week, round(sum(weight * coalesce(p.r, 0)), 6) + 0.0 AS gross, round(sum(moved), 6) AS turnover, round(sum(weight * coalesce(p.r, 0)) - 0.001 * sum(moved), 6) + 0.0 AS net FROM mv JOIN p ON p.week = mv.week AND p.series_id = mv.a GROUP BY 1""")
def inverse_volatility(spark, sf_dir):
    panel, cov = covariances(spark, sf_dir)
    rows = covariance.weighted_returns(covariance.inverse_volatility(cov), panel, "series_id", "week", "r")
    return rounded(rows.withColumnRenamed("at", "week"))


@query()
def equal_risk(spark, sf_dir):
    rows = covariance.equal_risk_weights(covariances(spark, sf_dir)[1])
    return rounded(rows.withColumnRenamed("at", "week"))
