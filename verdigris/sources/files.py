"""Return series and panels in CSV files with the file and line of every row, and an append-only ledger of trials."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The header names that are accepted, in any case.
RETURNS = ["return", "returns", "ret", "pnl"]
POSITIONS = ["position", "positions", "pos", "weight", "weights"]
DATES = ["date", "dates", "timestamp", "time", "datetime"]
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; in a temporary one where it is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="verdigris-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\uFEFF]+|[\s\uFEFF]+$", "")


def csv_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, line, cells) of lines that aren't blank, the header being line 1.

    Files are read in splits, as any text: a line's number is its place in its split after the lines of earlier splits,
    so no file passes through one task; a window holds one split. Cells are cut at commas; there are no quotes.
    """
    text = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    text = text.filter(stripped(F.col("value")) != "")
    sizes = text.groupBy("file", "block").agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    rows = text.withColumn("place", place).join(sizes.withColumn("before", before), ["file", "block"])
    return rows.select("file", (F.col("before") + F.col("place")).alias("line"), F.split("value", ",", -1).alias("cells"))


def headers(spark: SparkSession, paths: list[str], lines: DataFrame) -> DataFrame:
    """(file, names, keys) of every file: header cells without spaces around them, and in lower case; null in an empty file."""
    # scans pass over files of no bytes, so files come from the listing, whose names the driver holds anyway; it writes
    # the start of a local address otherwise than the scan does
    files = spark.createDataFrame([(f,) for f in spark.read.text(paths).inputFiles()], "listed string")
    first = lines.filter("line = 1").select("file", F.transform("cells", stripped).alias("names"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    found = files.join(first, plain("listed") == plain("file"), "left").withColumn("file", F.coalesce("file", "listed")).drop("listed")
    return found.withColumn("keys", F.transform("names", F.lower))


def column_of(names: list[str]) -> Column:
    """Number of the first header cell among ``names``, or null."""
    return F.get(F.filter(F.sequence(F.lit(0), F.size("keys") - 1), lambda i: F.get("keys", i).isin(names)), F.lit(0))


def number_of(cell: Column) -> tuple[Column, Column]:
    """A cell's finite number, and what is wrong where it has none; a missing cell is empty."""
    text = F.coalesce(stripped(cell), F.lit(""))
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    value = F.when(F.abs(value) < float("inf"), value)
    return value, F.when(text == "", F.lit("empty value")).when(value.isNull(), F.concat(F.lit("not a number: "), cell))


def read_returns(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, line, date, ret, position, error), a row for each line after the header, of files with a column of returns
    and perhaps of positions and dates (else null). A cell that is empty or no finite decimal number gives null and an
    ``error`` that names column and kind; a file without header or returns column is one row with an error and line null
    or 1."""
    lines = csv_lines(spark, list(paths))
    heads = headers(spark, list(paths), lines).withColumns({"r": column_of(RETURNS), "p": column_of(POSITIONS), "d": column_of(DATES)})
    wrong = F.when(F.col("keys").isNull(), "no header").when(F.col("r").isNull(), "no returns column")
    bad = heads.filter(wrong.isNotNull()).select("file", F.when(F.col("keys").isNotNull(), F.lit(1)).cast("long").alias("line"), F.lit(None).cast("string").alias("date"), F.lit(None).cast("double").alias("ret"), F.lit(None).cast("double").alias("position"), wrong.alias("error"))
    rows = lines.filter("line > 1").join(heads.filter("r IS NOT NULL"), "file")
    (ret, no_ret), (position, no_position) = number_of(F.get("cells", F.col("r"))), number_of(F.get("cells", F.col("p")))
    named = lambda at, error: F.concat(F.get("names", at), F.lit(": "), error)
    error = F.coalesce(named(F.col("r"), no_ret), F.when(F.col("p").isNotNull(), named(F.col("p"), no_position)))
    date = F.when(F.col("d").isNotNull(), F.coalesce(stripped(F.get("cells", F.col("d"))), F.lit("")))
    return rows.select("file", F.col("line").cast("long").alias("line"), date.alias("date"), ret.alias("ret"), F.when(F.col("p").isNotNull(), position).alias("position"), error.alias("error")).unionByName(bad)


def read_panel(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, line, date, asset, value, error), a row for each line and asset, of files with a date column and one for
    each asset. Errors as in ``read_returns``; a file without header, date or assets is one row with an error."""
    lines = csv_lines(spark, list(paths))
    heads = headers(spark, list(paths), lines).withColumn("d", column_of(DATES))
    wrong = F.when(F.col("keys").isNull(), "no header").when(F.col("d").isNull(), "no date column").when(F.size("keys") < 2, "no asset columns")
    none = F.lit(None).cast("string")
    bad = heads.filter(wrong.isNotNull()).select("file", F.when(F.col("keys").isNotNull(), F.lit(1)).cast("long").alias("line"), none.alias("date"), none.alias("asset"), none.cast("double").alias("value"), wrong.alias("error"))
    rows = lines.filter("line > 1").join(heads.filter(wrong.isNull()), "file")
    rows = rows.select("file", "line", "cells", "d", F.coalesce(stripped(F.get("cells", F.col("d"))), F.lit("")).alias("date"), F.posexplode("names").alias("k", "asset")).filter("k <> d")
    value, no_value = number_of(F.get("cells", F.col("k")))
    return rows.select("file", F.col("line").cast("long").alias("line"), "date", "asset", value.alias("value"), F.concat("asset", F.lit(": "), no_value).alias("error")).unionByName(bad)


def checked(rows: DataFrame) -> DataFrame:
    """``rows`` as read, without the error column; the job fails at the first error, with its file and line."""
    where = F.concat(F.col("file"), F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("-")), F.lit(": "), F.col("error"))
    return rows.filter(F.when(F.col("error").isNotNull(), F.raise_error(where).cast("boolean")).otherwise(True)).drop("error")


LEDGER = "hash string, label string, timestamp string, trials long, run_id string"
#: Equal trials of one line that are listed at a time.
LISTED = 4096


def record_trials(rows: DataFrame, config: list[str], path: str, run_id: str, label: Column | None = None, timestamp: Column | None = None) -> None:
    """Append the trials of all rows, repeated ones too: the hash of their ``config`` (column names in order, nulls told
    apart from empty strings), label, time and run. Equal trials of a run are one line with their number, counted
    before they are shuffled. A run writes its own part as a whole, so that a rerun changes nothing twice and other runs'
    trials stay."""
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(config)]), {"ignoreNullFields": "false"})
    nothing = F.lit(None).cast("string")
    # half as long as its digits, and of one size whatever the configuration's
    each = rows.select(F.unhex(F.sha2(text, 256)).alias("hash"), (nothing if label is None else label.cast("string")).alias("label"), (nothing if timestamp is None else timestamp.cast("string")).alias("timestamp"))
    out = each.groupBy("hash", "label", "timestamp").agg(F.count(F.lit(1)).alias("trials")).withColumn("hash", F.lower(F.hex("hash")))
    out.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path.rstrip('/')}/run_id={quote(run_id, safe='')}")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a ledger; one without a number of trials is one trial."""
    return spark.read.schema(LEDGER).json(path).withColumn("trials", F.coalesce("trials", F.lit(1)).cast("long"))


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """(hash, label, timestamp, run_id), a row for each trial."""
    lines = read_ledger(spark, path)
    names = [c for c in lines.columns if c != "trials"]
    parts = lines.select(*names, "trials", F.explode(F.sequence(F.lit(1).cast("long"), F.col("trials"), F.lit(LISTED).cast("long"))).alias("at"))
    size = F.least(F.lit(LISTED), F.col("trials") - F.col("at") + 1).cast("int")
    return parts.select(*names, F.explode(F.array_repeat(F.lit(0), size))).drop("col")


def trial_counts(trials: DataFrame, by: str = "label") -> DataFrame:
    """By label: distinct configurations and recorded trials, of single trials or of ledger lines. Counted in two steps,
    so one label is not one task."""
    runs = F.sum("trials") if "trials" in trials.columns else F.count(F.lit(1))
    each = trials.groupBy(by, "hash").agg(runs.alias("runs"))
    return each.groupBy(by).agg(F.count(F.lit(1)).alias("trials"), F.sum("runs").alias("runs"))
