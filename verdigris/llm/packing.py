"""Packing along a Hilbert curve through projected document vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, parallelism
from .tokens import BYTES, encoder, pieces, widen

#: Sizes of the hashed document vectors, of their projections, and of a curve coordinate in bits.
HASHED, DIMENSIONS, LEVEL = 1024, 4, 8
#: Low bits of a sort key, from the doc_id's hash: they part documents in one cell of the curve.
TIE_BITS = 20


def projection(hashed: int = HASHED, dimensions: int = DIMENSIONS, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((hashed, dimensions))


def document_vector(ids: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Projection of a document's hashed id counts, damped by log(1 + n) and scaled to unit length."""
    slots = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)
    counts = np.log1p(np.bincount((slots % len(matrix)).astype(np.int64), minlength=len(matrix)))
    return counts @ matrix / max(np.linalg.norm(counts), 1e-12)


def hilbert_key(points: np.ndarray, level: int = LEVEL) -> np.ndarray:
    """Places on the Hilbert curve of integer ``points`` (n, d) with coordinates under ``2**level``.

    From the highest bit down, a set bit mirrors the lower bits of the first coordinate, a clear one swaps them with
    the first coordinate's; the Gray code of what results, read across coordinates, is the place.
    """
    x = points.astype(np.int64).T.copy()
    d = len(x)
    for bit in range(level - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(d):
            high = (x[i] >> bit & 1).astype(bool)
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(level - 1, 0, -1):
        turn = np.where(x[d - 1] >> bit & 1, turn ^ ((1 << bit) - 1), turn)
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(level - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> bit & 1)
    return key


def encoded(docs: DataFrame, vocabulary: str, end: int, spaced: bool) -> DataFrame:
    """doc_id, ids (16-bit), n_tokens and the projected vector of every whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, matrix = encoder(vocabulary, spaced), projection()
        for whole in batches:
            for batch in pieces(whole, 1):
                ids = own.encode(batch.column(1).to_pylist(), end)
                at = [document_vector(np.frombuffer(x, "<u2"), matrix) for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // BYTES for x in ids], pa.int64()), *[pa.array([v[i] for v in at], pa.float64()) for i in range(DIMENSIONS)]], names=["doc_id", "ids", "n_tokens", *[f"v{i}" for i in range(DIMENSIONS)]])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary, n_tokens long, " + ", ".join(f"v{i} double" for i in range(DIMENSIONS)))


def curve_keys(rows: DataFrame, level: int = LEVEL, tie_bits: int = TIE_BITS) -> DataFrame:
    """Add ``sort_key``: the place on the curve, then bits of the doc_id's hash. A coordinate is scaled by the mean and
    deviation over all documents, three deviations either way filling the grid."""
    stats = rows.agg(*[f(f"v{i}").alias(f"{n}{i}") for i in range(DIMENSIONS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(DIMENSIONS)])
    spread = np.array([stats[f"s{i}"] or 1.0 for i in range(DIMENSIONS)])

    @F.pandas_udf("long")
    def place(*v: pd.Series) -> pd.Series:
        z = (np.stack([x.to_numpy() for x in v], axis=1) - mean) / spread
        return pd.Series(hilbert_key(np.clip((z + 3) / 6 * (1 << level), 0, (1 << level) - 1).astype(np.int64), level))

    tie = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << tie_bits) - 1))
    return rows.withColumn("sort_key", F.shiftleft(place(*[f"v{i}" for i in range(DIMENSIONS)]), tie_bits) + tie)


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end: int = 1, length: int = 2048, spaced: bool = True) -> DataFrame:
    """The pieces of all ``docs`` in sequences of ``length`` ids: doc_id, start, length, doc_tokens, sequence_id,
    offset and ids (unsigned 32-bit, little-endian).

    Documents follow the Hilbert curve through their projected vectors, so a sequence holds neighbours. Their ids form
    one stream that is cut every ``length`` ids; only the last sequence is short. Curve ranges are cut at quantiles of
    the sort key, in which the doc_id's hash parts equal texts, so a group of copies of any size spreads over ranges.
    Totals by range, as many as there are ranges, give each its place in the stream.

    Null and empty texts are the end id. Null doc_ids are values like others; repeated rows are packed each; an empty
    table gives none. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = materialize(encoded(docs, vocabulary, end, spaced), "tokens")
    return _cut(spark, curve_keys(rows), length)


def _cut(spark, rows: DataFrame, length: int) -> DataFrame:
    slim = materialize(rows.select("sort_key", "n_tokens"), "keys")
    total = slim.agg(F.sum("n_tokens")).first()[0] or 0
    n = max(parallelism(spark), -(-total // 16_000_000))
    bounds = sorted(set(slim.approxQuantile("sort_key", [i / n for i in range(1, n)], 1 / (8 * n)))) if n > 1 else []
    # the range of a key: how many bounds it reaches
    place = F.lit(0) if not bounds else F.aggregate(F.array(*[F.lit(int(b)) for b in bounds]), F.lit(0), lambda a, b: a + (F.col("sort_key") >= b).cast("int"))
    sums = dict(slim.groupBy(place.alias("range")).agg(F.sum("n_tokens")).collect())
    base, at = [], 0
    for k in range(len(bounds) + 1):
        base.append(at)
        at += sums.get(k, 0)
    first = spark.sparkContext.broadcast(base)
    ranged = rows.select("doc_id", "ids", "sort_key", place.alias("range"))
    # a range is a partition: hashed numbers would put several in one and none in others
    ranged = ranged.repartitionById(n, "range").sortWithinPartitions("range", "sort_key", "doc_id", F.crc32("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pos = None, 0
        for whole in batches:
            for batch in pieces(whole, 1):
                out: list[list] = [[] for _ in range(7)]
                for name, ids, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    if k != now:
                        now, pos = k, first.value[k]
                    flat, at = widen(ids), 0
                    while at < len(flat):
                        seq, offset = divmod(pos, length)
                        size = min(length - offset, len(flat) - at)
                        for column, value in zip(out, (name, at, size, len(flat), seq, offset, flat[at : at + size].tobytes())):
                            column.append(value)
                        at, pos = at + size, pos + size
                yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), *[pa.array(x, pa.int64()) for x in out[1:6]], pa.array(out[6], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    kind = dict(rows.dtypes)["doc_id"]
    return ranged.select("doc_id", "ids", "range").mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
