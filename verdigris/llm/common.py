"""Helpers that every operator of the subpackage shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a temporary one only where none is set, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="verdigris-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Spark's setting to drop a query's shuffle files once the query has ended.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, by: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder, in folders ``by`` a column if there is one, and return the
    table: it cuts the lineage, and a lost executor costs no recomputation of what came before. The shuffle files behind
    it go once it is written."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    held = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.options(**({"compression": "zstd"} | options)).parquet(path, partitionBy=by)
    finally:
        spark.conf.set(DROP_SHUFFLES, held)
    return spark.read.schema(df.schema).parquet(path)


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """Column names like ``wanted`` that clash with none of ``taken`` (Spark compares names without case)."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def crc32_text(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def two_hashes(text: Column) -> tuple[Column, Column]:
    """128 bits of hash of a text, as two longs."""
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


#: Bits of a filter at least and at most (16 MB), and for each value.
LEAST_BITS, MOST_BITS, BITS_EACH = 20, 27, 16


def bits_for(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * n).bit_length()))


def filter_words(rows: DataFrame, name: str, bits: int, *by: str) -> DataFrame:
    """(by, word, bits): the 64-bit words of a filter of ``2**bits`` bits that have any set."""
    spot = F.col(name).bitwiseAND(F.lit((1 << bits) - 1))
    return rows.groupBy(*by, F.shiftright(spot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{name}` & 63L AS int))")).alias("bits"))


def collected(words: DataFrame, bits: int) -> np.ndarray:
    words = words.select("word", "bits").toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def bit_filter(rows: DataFrame, name: str) -> np.ndarray:
    """A bit for each hash in ``rows[name]``, as 64-bit words: those that are there have theirs set, and few others
    unless they are over ``2**MOST_BITS / BITS_EACH``. ``MOST_BITS`` bounds what is sent, whatever goes in; past it more
    rows get through, and the join that follows settles all of them."""
    bits = bits_for(rows.count())
    return collected(filter_words(rows, name, bits), bits)


def bit_filters(rows: DataFrame, name: str, by: str, n: int) -> Iterator[np.ndarray]:
    """A ``bit_filter`` of the rows of each value of ``by`` from 0 to ``n - 1``, all of the largest one's size and found
    by one query."""
    bits = bits_for(rows.groupBy(by).count().agg(F.max("count")).first()[0] or 0)
    words = materialize(filter_words(rows, name, bits, by), "words")
    for k in range(n):
        yield collected(words.filter(F.col(by) == k), bits)


#: Bits of a membership filter: its words are 2^18 rows at most, whatever goes in.
FILTER_BITS = 1 << 24


def mark_maybe(rows: DataFrame, key: Column, wanted: DataFrame, name: str, flag: str) -> DataFrame:
    """Add ``flag``: whether ``key`` (a hash) may be in ``wanted[name]``; true for all that are, and few others while
    the filter is sparse. It is broadcast at a size that ``FILTER_BITS`` bounds."""
    spot = lambda x: F.pmod(x, F.lit(FILTER_BITS))
    word, bit, bits = fresh(rows.columns, "_word", "_bit", "_bits")
    one = F.expr(f"shiftleft(1L, cast({bit} AS int))")
    words = wanted.select(F.shiftright(spot(F.col(name)), 6).alias(word), spot(F.col(name)).bitwiseAND(F.lit(63)).alias(bit))
    words = words.groupBy(word).agg(F.bit_or(one).alias(bits))
    held = rows.withColumn(word, F.shiftright(spot(key), 6)).withColumn(bit, spot(key).bitwiseAND(F.lit(63)))
    return held.join(F.broadcast(words), word, "left").withColumn(flag, F.coalesce(F.col(bits).bitwiseAND(one) != 0, F.lit(False))).drop(word, bit, bits)


def maybe_in(rows: DataFrame, key: Column, wanted: DataFrame, name: str) -> DataFrame:
    """The rows that ``mark_maybe`` marks: it keeps most others out of the join that follows."""
    (flag,) = fresh(rows.columns, "_maybe")
    return mark_maybe(rows, key, wanted, name, flag).filter(flag).drop(flag)
