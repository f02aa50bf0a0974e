"""Token-id files: documents compressed one by one with a shared dictionary, and an offset index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parallelism
from .tokens import BYTES, encoder, pieces, token_ids, widen

#: Bounds of what the dictionary is trained on: documents, and ids of each; and of the dictionary, in bytes.
SAMPLE_DOCUMENTS, SAMPLE_IDS, DICTIONARY_BYTES = 2000, 2048, 65_536
BLOCK_BYTES = 4_000_000
FILES = "block long, dictionary_hash string, doc_ids array<long>, offsets array<long>, counts array<long>, first long, data binary"


def train_dictionary(docs: DataFrame, vocabulary: str, end: int, spaced: bool, n: int = SAMPLE_DOCUMENTS, ids: int = SAMPLE_IDS) -> bytes:
    """A zstandard dictionary from serialized ids of ``n`` documents at most, those lowest in hash order, and of at
    most ``ids`` ids of each. Only this bounded sample reaches the driver. Too little to train on gives the sample's
    own bytes as a raw dictionary (empty for an empty table): documents are stored whole in any case."""
    rank = F.xxhash64("doc_id")
    # hashes alone are sorted; of the texts only the sample's are read
    last = docs.select(rank.alias("rank")).orderBy("rank").limit(n).agg(F.max("rank")).first()[0]
    sample = docs.select("doc_id", "text").filter(rank <= F.lit(last))
    # repeated doc_ids may bring more: the order makes the choice the same in every run
    short = token_ids(sample, vocabulary, end, spaced).select("doc_id", F.substring("ids", 1, ids * BYTES).alias("ids")).orderBy(F.xxhash64("doc_id"), "doc_id", "ids").select("ids").limit(2 * n)
    rows = sorted(bytes(r[0]) for r in short.collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, rows, threads=0).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(rows)[:DICTIONARY_BYTES]


def dictionary_hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()


def write_ids(docs: DataFrame, vocabulary: str, end: int, spaced: bool = False, level: int = 3) -> tuple[DataFrame, DataFrame]:
    """Write the ids of all ``docs`` in ascending doc_id order; return the tables (files, dictionary).

    A row of ``files`` is a block of about 4 MB: its number (file << 32 | place in the file), the hash of its
    dictionary, the doc_ids, the offset of each document's frame in ``data`` (and the end of the last), their counts
    of ids, and the ids before the block in its file. Each document is a frame of its own, so reading one takes its
    slice and the dictionary.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, vocabulary, end, spaced)
    mark = dictionary_hash(dictionary)
    shared = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, spaced)
        squeeze = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(shared.value), write_content_size=True).compress
        names, frames, counts, first, place, number = [], [], [], 0, 0, None

        def block() -> pa.RecordBatch:
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in frames])))
            return pa.RecordBatch.from_arrays(
                [pa.array([number << 32 | place]), pa.array([mark]), pa.array([names], pa.list_(pa.int64())), pa.array([offsets.tolist()], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([first]), pa.array([b"".join(frames)], pa.binary())],
                names=["block", "dictionary_hash", "doc_ids", "offsets", "counts", "first", "data"],
            )

        held = 0
        for whole in batches:
            for batch in pieces(whole, 1):
                number = batch.column(2)[0].as_py()
                for name, ids in zip(batch.column(0).to_pylist(), own.encode(batch.column(1).to_pylist(), end)):
                    names.append(name)
                    frames.append(squeeze(ids))
                    counts.append(len(ids) // BYTES)
                    held += len(frames[-1])
                    if held >= BLOCK_BYTES:
                        yield block()
                        first, place, held = first + sum(counts), place + 1, 0
                        names, frames, counts = [], [], []
        if names:
            yield block()

    # the hash parts rows with one doc_id, so that such a key is not one task's
    n = max(parallelism(spark), 2)
    rows = docs.select("doc_id", "text").repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows = rows.withColumn("file", F.spark_partition_id().cast("long"))
    files = materialize(rows.mapInArrow(run, FILES), "ids", compression="uncompressed")
    return files, materialize(spark.createDataFrame([(mark, bytearray(dictionary))], "dictionary_hash string, dictionary binary").coalesce(1), "dictionary")


def read_ids(files: DataFrame, dictionary: DataFrame, only: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens and ids (unsigned 32-bit, little-endian) from the files;
    with ``only``, of these documents, decompressing no other. A file that names another dictionary is refused."""
    (row,) = dictionary.collect()
    shared, mark = files.sparkSession.sparkContext.broadcast(bytes(row["dictionary"])), row["dictionary_hash"]
    wanted = set(only) if only is not None else None
    if only is not None:
        files = files.filter(F.arrays_overlap("doc_ids", F.array(*[F.lit(x).cast("long") for x in only])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared.value)).decompress
        for batch in batches:
            for r in batch.to_pylist():
                if r["dictionary_hash"] != mark:
                    raise ValueError(f"block {r['block']} was written with another dictionary")
                view, at, start = memoryview(r["data"]), r["offsets"], r["first"]
                rows: tuple[list, ...] = ([], [], [], [])
                for k, (name, n) in enumerate(zip(r["doc_ids"], r["counts"])):
                    if wanted is None or name in wanted:
                        ids = expand(view[at[k] : at[k + 1]])
                        if len(ids) != n * BYTES:
                            raise ValueError(f"block {r['block']}: document {name} has {len(ids) // BYTES} ids, not {n}")
                        for column, value in zip(rows, (name, start, n, widen(ids).tobytes())):
                            column.append(value)
                    start += n
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array([r["block"] >> 32] * len(rows[0]), pa.int64()), *[pa.array(x, pa.int64()) for x in rows[1:3]], pa.array(rows[3], pa.binary())], names=["doc_id", "file", "start", "n_tokens", "ids"])

    return files.mapInArrow(run, "doc_id long, file long, start long, n_tokens long, ids binary")


def file_starts(files: DataFrame) -> DataFrame:
    """(file, before): the ids in all earlier files; one row a file, as many as the writer had tasks."""
    sums = files.groupBy(F.shiftright("block", 32).alias("file")).agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def id_digests(docs: DataFrame, vocabulary: str, end: int, spaced: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files that it writes.

    Null and empty texts are the end id alone. Null doc_ids come first; rows with one doc_id are in the order of
    their texts' hashes, and equal rows in any. An empty table gives none. Other columns are not read.
    """
    files, dictionary = write_ids(docs, vocabulary, end, spaced)
    rows = read_ids(files, dictionary).withColumn("ids_crc32", F.crc32("ids"))
    return rows.join(F.broadcast(file_starts(files)), "file").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
