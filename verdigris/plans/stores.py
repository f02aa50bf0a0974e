"""Queries that write tables as files or ledgers and read them back, and the SQL that they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files
from ..sources.tables import daily_series, table
from .queries import DAILY, query, rounded


@query(DAILY + " SELECT series_id, count(r) AS n, count(*) FILTER (r IS NULL) AS errors, count(DISTINCT day) AS dates, round(sum(r), 6) AS total FROM s GROUP BY 1")
def returns_files(spark, sf_dir):
    path = files.shared_path(spark, "returns")
    daily_series(spark, sf_dir).select("series_id", F.col("day").alias("Date"), F.col("r").alias(" Return ")).write.partitionBy("series_id").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    rows = files.read_returns(spark, f"{path}/series_id=*")
    rows = rows.withColumn("series_id", F.regexp_extract("file", "series_id=([0-9]+)", 1).cast("long"))
    return rounded(rows.groupBy("series_id").agg(F.count("ret").alias("n"), F.count("error").alias("errors"), F.count_distinct("date").alias("dates"), F.sum("ret").alias("total")))


@query("SELECT l_returnflag AS label, count(DISTINCT {'a': l_linestatus, 'b': l_suppkey}) AS trials, 2 * count(*) AS runs FROM lineitem GROUP BY 1")
def trial_ledger(spark, sf_dir):
    path = files.shared_path(spark, "trials")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey", "l_linestatus")
    # the second run of "a" is a rerun: it counts once
    for run in ("a", "b/c", "a"):
        files.record_trials(rows, ["l_suppkey", "l_linestatus"], path, run, F.col("l_returnflag"))
    return rounded(files.trial_counts(files.read_ledger(spark, path)))
