"""Rendezvous (highest random weight) sharding over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_text, fresh, materialize

#: Stands for a null key; no key that is cast to a string starts with U+0000.
NULL_KEY = "\x00null"


def assign_shards(df: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 40, grown_weight: float = 1.0, shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """Add ``shard``, the shard with the highest score of ``df[key]``, and ``grown``, the one with a further shard.

    The score of shard s is ``-weight / ln(u)`` with u in (0, 1) from XXH64 (seed 42) of ``key#s``. A shard's share of
    the keys is its share of the weights, and since no score depends on the other shards, a further shard takes rows
    from all of them only into itself. Ties go to the lower shard number. It is one projection without a shuffle.

    A null key is a key of its own. Equal keys, repeated rows among them, share a shard. An empty table stays empty.
    Other columns pass through; ``shard`` and ``grown`` replace columns with these names.
    """
    if not weights or min(*weights, grown_weight) <= 0:
        raise ValueError("weights must be positive")
    n = len(weights)
    (k,) = fresh(df.columns, "rendezvous")
    w = F.array(*[F.lit(float(x)) for x in (*weights, grown_weight)])
    text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(NULL_KEY))
    unit = lambda s: (F.shiftrightunsigned(F.xxhash64(F.concat(text, F.lit("#"), s.cast("string"))), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    scores = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda s: F.struct((-F.element_at(w, s + 1) / F.ln(unit(s))).alias("score"), (-s).alias("back")))
    out = df.drop(shard, grown).withColumn(k, scores)
    return out.withColumns({shard: -F.array_max(F.slice(k, 1, n))["back"], grown: -F.array_max(F.col(k))["back"]}).drop(k)


def number_slots(df: DataFrame, shard: str = "shard", n_buckets: int = 256, slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    Rows are dealt into ``n_buckets`` hash buckets a shard; a table of shards x ``n_buckets`` totals, whose size these
    two bound, gives each bucket its first slot, so no window spans a shard. Repeated rows are counted before they
    are dealt and spread again at the end, so a row repeated any number of times is one row in the window.
    Null values are values like others; which of two equal rows comes first doesn't show.
    """
    names = df.columns
    n, bucket, total, base, end = fresh(names, "copies", "bucket", "bucket_rows", "base", "last")
    rows = df.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.count(F.lit(1)).alias(n))
    rows = rows.withColumn(bucket, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.lit(n_buckets)))
    sums = rows.groupBy(shard, bucket).agg(F.sum(n).alias(total))
    before = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(shard, bucket, F.coalesce(F.sum(total).over(before), F.lit(0)).alias(base))
    within = Window.partitionBy(shard, bucket).orderBy(*[F.col(f"`{c}`") for c in names]).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(F.broadcast(bases), [shard, bucket]).withColumn(end, F.col(base) + F.sum(n).over(within))
    return rows.select(*[F.col(f"`{c}`") for c in names], F.explode(F.sequence(F.col(end) - F.col(n), F.col(end) - 1)).alias(slot))


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * 40, overhead: int = 16) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus ``overhead``), text_crc32, law, shard, slot and grown_shard of every document.

    Null and empty texts have size ``overhead`` and checksum 0.
    """
    slim = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long").alias("size"), crc32_text(F.col("text")).alias("text_crc32"))
    placed = materialize(assign_shards(slim, weights=weights), "shards")
    return number_slots(placed).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.col("grown_shard").cast("int"))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 40) -> None:
    """Write ``df`` as one folder a shard, each by several tasks."""
    assign_shards(df, key, weights).drop("grown_shard").write.partitionBy("shard").parquet(path)
