"""Removal of long substrings that earlier documents hold, by matching statistics against run-length indexes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, bit_filters, mark_maybe, materialize, parallelism, two_hashes
from .runindex import PLACE_BITS, SEPARATOR, RunIndex, ranges
from .tokens import pieces

#: Bytes of a match, and of the strings (seeds) whose hash deals windows of that size into buckets.
MATCH, SEED = 50, 24
#: Bytes of segments that are indexed at once; buckets with more different ones are dealt on. Windows of a segment, and
#: bytes of text that are cut at once. Segments of a bucket from which on equal ones are combined before the shuffle.
BATCH, MOST_WINDOWS, PIECE, HEAVY = 500_000, 256, 1 << 18, 100
#: Batches of light buckets that are read at once.
READ = 4
#: Low bits of the seeds that are counted together, and seeds that a task sorts at once.
CELL_BITS, SORTED = 12, 1 << 20
#: Windows whose seeds are found at once, so that all steps' numbers stay in a core's cache.
CACHED = 1 << 15
#: Bytes of the texts that share a filter of seeds; a filter for all would let nearly all segments through at some size.
PART = 1 << 29
LAST = (1 << 63) - 1  # stands for no doc_id: such documents come after all others


def mixed(text: np.ndarray, sizes: tuple[int, ...], salt: int = 0) -> np.ndarray:
    """A hash of the string from each place on that ``1 + sum(sizes)`` bytes have, a doubling at a time."""
    h = text.astype(np.uint64) + np.uint64(1 + salt)
    for size in sizes:
        x = h[size:] >> np.uint64(29)
        x ^= h[size:]
        h = h[:-size] * np.uint64(0x9E3779B97F4A7C15 + 2 * size)
        h += x
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def window_seeds(text: np.ndarray) -> np.ndarray:
    """The least hash of the ``SEED``-byte strings in each ``MATCH``-byte window; equal windows have equal ones."""
    out = np.empty(len(text) - MATCH + 1, np.uint64)
    for low in range(0, len(out), CACHED):
        h, size = mixed(text[low : low + CACHED + MATCH - 1], (1, 2, 4, 8, SEED - 16)), 1
        while 2 * size <= MATCH - SEED + 1:
            h, size = np.minimum(h[:-size], h[size:]), 2 * size
        rest = MATCH - SEED + 1 - size
        out[low : low + CACHED] = np.minimum(h[: len(h) - rest], h[rest:])
    return out


class Cut:
    """Segments of texts: stretches of windows with one seed, ``MOST_WINDOWS`` at most. ``owner`` is the text's number,
    ``at`` the first window's place in it, ``seed`` its seed, ``windows`` how many, ``start`` the place in ``flat``."""

    def __init__(self, pieces: list[tuple[int, int, bytes]]):
        self.flat = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
        sizes = np.array([len(p) for _, _, p in pieces])
        starts = np.cumsum(sizes) - sizes
        ends = starts + sizes - MATCH + 1
        seeds = window_seeds(self.flat)
        new = np.concatenate(([True], seeds[1:] != seeds[:-1]))
        for low, high in zip(starts.tolist(), ends.tolist()):
            new[low:high:MOST_WINDOWS] = True
            new[high : high + MATCH - 1] = False  # these would go on into the next text
        head = np.flatnonzero(new)
        piece = np.searchsorted(starts, head, "right") - 1
        self.windows = np.minimum(np.append(head[1:], len(new)), ends[piece]) - head
        self.start, self.seed = head, seeds[head].view(np.int64)
        self.owner = np.array([o for o, _, _ in pieces])[piece]
        self.at = head - starts[piece] + np.array([a for _, a, _ in pieces])[piece]


def cuts(texts: list[bytes]) -> Iterator[Cut]:
    """The segments of all windows of ``texts``, about ``PIECE`` bytes at a time, however long a text is."""
    held, size = [], 0
    for k, text in enumerate(texts):
        for at in range(0, len(text) - MATCH + 1, PIECE):
            held.append((k, at, text[at : at + PIECE + MATCH - 1]))
            size += len(held[-1][2])
            if size >= PIECE:
                yield Cut(held)
                held, size = [], 0
    if held:
        yield Cut(held)


def binaries(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Strings of bytes, ``sizes`` from ``starts`` on."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat[ranges(starts, sizes)]))])


def packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """``values`` from each of ``edges`` to the next, as strings of their bytes."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def of_one_part(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    """``batch`` cut where the part, its second column, changes."""
    part = batch.column(1).to_numpy()
    edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    return [batch.slice(low, high - low) for low, high in zip(edges, edges[1:]) if high > low]


def shared_seeds(docs: DataFrame) -> DataFrame:
    """(bucket, n): the seeds that ``n``, over one, segments of all whole texts have. If ``docs`` has ``part``, also
    (part): a row for each part with texts that have the seed; ``n`` counts all parts.

    A task sorts its seeds with the low bits first, counts the different ones and sends those of a cell, which has the
    same ``CELL_BITS`` low bits, as one row: nearly all are different, and a row for each would cost several times more.
    """
    rest = np.uint64(64 - CELL_BITS)
    by_part = "part" in docs.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, part = [], 0, 0

        def rows() -> pa.RecordBatch:
            seed = np.concatenate(held).view(np.uint64)
            key = np.sort(seed << rest | seed >> np.uint64(CELL_BITS))
            head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            key, n = key[head], np.diff(np.append(head, len(key))).astype(np.int32)
            cell = (key >> rest).view(np.int64)
            edges = np.concatenate(([0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]))
            own = pa.array(np.full(len(edges) - 1, part, np.int32))
            return pa.RecordBatch.from_arrays([pa.array(cell[edges[:-1]]), own, packed(n, edges), packed(key, edges)], names=["cell", "part", "counts", "keys"])

        for whole in (one for batch in batches for one in (of_one_part(batch) if by_part else [batch])):
            now = whole.column(1)[0].as_py() if by_part and whole.num_rows else part
            if held and now != part:
                yield rows()
                held, size = [], 0
            part = now
            for batch in pieces(whole, 0):
                for cut in cuts(batch.column(0).to_pylist()):
                    held.append(cut.seed)
                    size += len(cut.seed)
                    if size >= SORTED:
                        yield rows()
                        held, size = [], 0
        if held:
            yield rows()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_buckets(batches, 8 * SORTED):
            n, key = (bytes_of(rows.column(c).combine_chunks())[0].view(kind) for c, kind in (("counts", np.int32), ("keys", np.uint64)))
            part = np.repeat(rows.column("part").to_numpy(), pc.binary_length(rows.column("keys")).to_numpy() // key.itemsize)
            order = np.argsort(key, kind="stable")  # a cell's rows come by part
            key, part = key[order], part[order]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            head = np.flatnonzero(new)
            n = np.add.reduceat(n[order].astype(np.int64), head)[np.cumsum(new) - 1]
            use = np.flatnonzero((new | np.concatenate(([True], part[1:] != part[:-1]))) & (n > 1))
            key = key[use]
            bucket = pa.array((key << np.uint64(CELL_BITS) | key >> rest).view(np.int64))
            yield pa.RecordBatch.from_arrays([*([pa.array(part[use])] if by_part else []), bucket, pa.array(n[use])], names=[*own, "bucket", "n"])

    own = ["part"] if by_part else []
    rows = docs.select("raw", *own).mapInArrow(deal, "cell long, part int, counts binary, keys binary")
    rows = rows.repartition(parallelism(docs.sparkSession), "cell").sortWithinPartitions("cell", "part")
    return rows.mapInArrow(count, ", ".join([*(f"{c} int" for c in own), "bucket long, n long"]))


def has(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether the filter ``bits`` may hold the hashes ``x``."""
    spot = x & (64 * len(bits) - 1)
    return (bits[spot >> 6] >> (spot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def segments(docs: DataFrame, words: list, heavy_words, heavy: bool) -> DataFrame:
    """(bucket, doc_id, t, at, s): the segments whose seeds may be shared, as the broadcast filter in ``words`` of their
    ``part`` says, and may be (``heavy``) or are not (else) in ``heavy_words``; each has all bytes of its windows, so
    segments overlap."""
    found = [part_segments(docs.filter(F.col("part") == k), own, heavy_words, heavy) for k, own in enumerate(words)]
    return reduce(DataFrame.union, found)


def part_segments(docs: DataFrame, words, heavy_words, heavy: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, 2)):
            name, t = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for cut in cuts(batch.column(2).to_pylist()):
                use = np.flatnonzero(has(words.value, cut.seed) & (has(heavy_words.value, cut.seed) == heavy))
                own = cut.owner[use]
                yield pa.RecordBatch.from_arrays([pa.array(cut.seed[use]), pa.array(name[own]), pa.array(t[own]), pa.array(cut.at[use]), binaries(cut.flat, cut.start[use], cut.windows[use] + MATCH - 1)], names=["bucket", "doc_id", "t", "at", "s"])

    return docs.select("doc_id", "t", "raw").mapInArrow(run, "bucket long, doc_id long, t long, at long, s binary")


def matchable(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of the segments with a window whose hash comes twice: all that share one, and few others. Segments of
    a bucket have a seed in common, but mostly no whole window."""
    counts = sizes - MATCH + 1
    hashes = [mixed(flat[low : low + CACHED + MATCH - 1], (1, 2, 4, 8, 16, 16, 2)) for low in range(0, len(flat) - MATCH + 1, CACHED)]
    x = np.concatenate(hashes)[ranges(starts, counts)]
    order = np.sort(x)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return np.zeros(0, np.int64)
    found = again[np.minimum(np.searchsorted(again, x), len(again) - 1)] == x
    return np.flatnonzero(np.logical_or.reduceat(found, np.cumsum(counts) - counts))


def earlier_matches(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bucket: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each place of the segments whether a match of ``MATCH`` bytes with one of its bucket that a smaller ``first``
    holds starts there. Segments come in the order of (bucket, first). Those without a window that another may have are
    neither indexed nor streamed."""
    hit = np.zeros(len(flat), bool)
    use = matchable(flat, starts, sizes)
    if len(use):
        own = bucket[use]
        ends = np.append(np.flatnonzero(own[1:] != own[:-1]) + 1, len(own))
        # whole buckets, up to ``BATCH`` bytes and one bucket more
        size = np.cumsum(sizes[use])[ends - 1]
        low = 0
        while low < len(use):
            k = int(np.searchsorted(ends, low))
            done = int(size[k]) if low else 0
            high = int(ends[min(int(np.searchsorted(size, done + BATCH)), len(ends) - 1)])
            part = use[low:high]
            mark_matches(hit, flat, starts[part], sizes[part], bucket[part], first[part])
            low = high
    return hit


def mark_matches(hit: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bucket: np.ndarray, first: np.ndarray) -> None:
    """Set ``hit`` at the places of ``earlier_matches``.

    The documents of a bucket are numbered, and split by each bit of the number in turn: those with a clear bit are
    indexed, and those with a set one and equal higher bits are streamed against the index. So each pair of documents
    meets once, and an index never holds what comes after a streamed segment.
    """
    new_bucket = np.concatenate(([True], bucket[1:] != bucket[:-1]))
    new_doc = new_bucket | np.concatenate(([True], first[1:] != first[:-1]))
    number = np.cumsum(new_doc)
    number -= number[np.maximum.accumulate(np.where(new_bucket, np.arange(len(bucket)), 0))]
    own = np.cumsum(new_bucket)
    held: list[tuple[np.ndarray, ...]] = []

    def search() -> None:
        """All splits held, in one index: each node of each is a group of its own."""
        indexed, group, read, among = (np.concatenate(x) for x in zip(*held))
        size = sizes[indexed] + 1
        text = np.full(int(size.sum()), SEPARATOR, np.uint8)
        text[ranges(np.cumsum(size) - size, size - 1)] = flat[ranges(starts[indexed], size - 1)]
        index = RunIndex(text, np.repeat(group, size))
        part, place = ranges(starts[read], sizes[read]), np.cumsum(sizes[read]) - sizes[read]
        # a segment is streamed in several splits
        hit[part[index.matching_statistics(flat[part], place, sizes[read], among) >= MATCH]] = True

    bit, groups, total = 0, 0, 0
    while (number >> bit).any():
        high = number >> (bit + 1)
        node = groups + np.cumsum(np.concatenate(([False], (own[1:] != own[:-1]) | (high[1:] != high[:-1]))))
        later = (number >> bit & 1) == 1
        with_both = np.zeros(int(node[-1]) + 1, bool)
        with_both[node[later]] = True
        indexed, read = np.flatnonzero(~later & with_both[node]), np.flatnonzero(later)
        size = int((sizes[indexed] + 1).sum())
        if held and total + size >= 1 << PLACE_BITS - 1:
            search()
            held, total = [], 0
        held.append((indexed, node[indexed], read, node[read]))
        bit, groups, total = bit + 1, int(node[-1]) + 1, total + size
    if held:
        search()


def whole_buckets(batches: Iterator[pa.RecordBatch], batch_bytes: int) -> Iterator[pa.Table]:
    """The rows (bucket first, segment last; in the order of buckets), ``batch_bytes`` of segments at a time and one
    bucket more at most: an index takes twice ``BATCH``."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = batch.column(0).to_numpy()
        new = np.flatnonzero(np.concatenate(([last is not None and bucket[0] != last], bucket[1:] != bucket[:-1])))
        ends = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy().astype(np.int64))
        at, base = 0, 0
        while True:
            # the first bucket that starts once enough is held
            full = at if size >= batch_bytes else int(np.searchsorted(ends, base + batch_bytes - size)) + 1
            k = int(np.searchsorted(new, max(full, at if held else at + 1)))
            if k == len(new):
                break
            cut = int(new[k])
            yield pa.Table.from_batches([*held, batch.slice(at, cut - at)]).combine_chunks()
            held, size, at, base = [], 0, cut, int(ends[cut - 1]) if cut else 0
        held.append(batch.slice(at))
        size, last = size + int(ends[-1]) - base, bucket[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def longs(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows.column(c).to_numpy().astype(np.int64) for c in names]


def bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of ``strings`` one after the other, where each starts and how many it has."""
    _, offsets, flat = strings.buffers()
    ends = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    return np.frombuffer(flat, np.uint8)[ends[0] : ends[-1]], ends[:-1] - ends[0], np.diff(ends)


def stretches(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true values start and end."""
    edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_batch(name: np.ndarray, t: np.ndarray, at: np.ndarray, windows: np.ndarray, hit: np.ndarray) -> pa.RecordBatch:
    """Spans of segments whose matched windows are true in ``hit``, ``windows`` each. A run may go on from one segment
    to the next: it is cut there, as the other is elsewhere."""
    starts = np.cumsum(windows) - windows
    own = np.repeat(np.arange(len(windows)), windows)
    # a false place between segments
    apart = np.zeros(len(hit) + len(windows), bool)
    apart[np.arange(len(hit)) + own] = hit
    low, high = stretches(apart)
    own = np.searchsorted(starts + np.arange(len(windows)), low, "right") - 1
    base = at[own] - starts[own] - own
    return pa.RecordBatch.from_arrays([pa.array(name[own]), pa.array(t[own]), pa.array(base + low), pa.array(base + high - 1 + MATCH)], names=["doc_id", "t", "a", "b"])


SPANS = "doc_id long, t long, a long, b long"


def bucket_order(rows: DataFrame) -> DataFrame:
    return rows.repartition(parallelism(rows.sparkSession), "bucket").sortWithinPartitions("bucket")


def light_spans(cut: DataFrame, batch_bytes: int) -> DataFrame:
    """(doc_id, t, a, b): the bytes from a to b of a document whose windows a smaller doc_id holds, by buckets that have
    so few segments that each task holds whole ones. Equal segments of a bucket are indexed once, and most of the others
    not at all, so ``READ`` times as much is read at once as is indexed: a search has as many steps, however few go in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_buckets(batches, READ * batch_bytes):
            bucket, name, t, at = longs(rows, "bucket", "doc_id", "t", "at")
            order = np.lexsort((name, bucket))
            # codes count up by first places; equal segments have equal seeds, so they are of one bucket
            coded = rows.column("s").combine_chunks().take(pa.array(order)).dictionary_encode()
            code = coded.indices.to_numpy().astype(np.int64)
            heads = order[np.unique(code, return_index=True)[1]]
            same = np.empty(len(order), np.int64)
            same[order] = code
            flat, starts, sizes = bytes_of(coded.dictionary)
            hit = earlier_matches(flat, starts, sizes, bucket[heads], name[heads])
            windows = sizes[same] - MATCH + 1
            own = hit[ranges(starts[same], windows)]
            own |= np.repeat(name > name[heads][same], windows)
            yield span_batch(name, t, at, windows, own)

    return bucket_order(cut).select("bucket", "doc_id", "t", "at", "s").mapInArrow(run, SPANS)


def first_matches(distinct: DataFrame, batch_bytes: int) -> DataFrame:
    """(bucket, sh, first, mask): of the different segments of each bucket those that a further document holds, or of
    which a smaller doc_id than ``first`` holds windows: these are the bits of ``mask``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_buckets(batches, batch_bytes):
            bucket, sh, first, last = longs(rows, "bucket", "sh", "first", "last")
            order = np.lexsort((first, bucket))
            flat, starts, sizes = bytes_of(rows.column("s").combine_chunks().take(pa.array(order)))
            hit = earlier_matches(flat, starts, sizes, bucket[order], first[order])
            any_hit = np.logical_or.reduceat(hit, starts)
            use = np.flatnonzero(any_hit | (first[order] < last[order]))
            masks = [np.packbits(hit[a : a + n - MATCH + 1]).tobytes() if x else None for a, n, x in zip(starts[use].tolist(), sizes[use].tolist(), any_hit[use].tolist())]
            own = order[use]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[own]), pa.array(sh[own]), pa.array(first[own]), pa.array(masks, pa.binary())], names=["bucket", "sh", "first", "mask"])

    return bucket_order(distinct).select("bucket", "sh", "first", "last", "s").mapInArrow(run, "bucket long, sh long, first long, mask binary")


def removed_spans(found: DataFrame) -> DataFrame:
    """(doc_id, t, a, b) as of ``light_spans``: all of a segment that it isn't the first to hold, else those of the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, t, at, windows, first = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
            masks = batch.column(5).to_pylist()
            hit = [np.ones(n, bool) if later else np.unpackbits(np.frombuffer(m, np.uint8), count=n).astype(bool) for n, later, m in zip(windows.tolist(), (name > first).tolist(), masks)]
            if hit:
                yield span_batch(name, t, at, windows, np.concatenate(hit))

    return found.select("doc_id", "t", "at", "n", "first", "mask").mapInArrow(run, SPANS)


def wide_spans(cut: DataFrame) -> DataFrame:
    """(doc_id, t, a, b) as of ``removed_spans``, from segments of buckets too large to be indexed in one task: each
    window goes by a 128-bit hash of its own, and smallest doc_ids are combined before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, t, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            parts = batch.column(3).to_pylist()
            for low in range(0, len(parts), 4096):
                own = parts[low : low + 4096]
                sizes = np.array([len(p) for p in own])
                flat, starts, counts = np.frombuffer(b"".join(own), np.uint8), np.cumsum(sizes) - sizes, sizes - MATCH + 1
                place = ranges(starts, counts)
                row = np.repeat(np.arange(low, low + len(own)), counts)
                x, y = (mixed(flat, (1, 2, 4, 8, 16, 16, 2), salt)[place].view(np.int64) for salt in (0, 77))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (name[row], t[row], at[row] + place - starts[row - low], x, y)], names=["doc_id", "t", "a", "x", "y"])

    windows = cut.select("doc_id", "t", "at", "s").mapInArrow(run, "doc_id long, t long, a long, x long, y long")
    least = windows.groupBy("x", "y").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most")
    return windows.join(least, ["x", "y"]).filter("least < doc_id").select("doc_id", "t", "a", (F.col("a") + MATCH).alias("b"))


def in_parts(reps: DataFrame, size: int) -> tuple[DataFrame, int]:
    """``reps``, ``size`` bytes of texts, written with ``part``, and the number of parts: a task's rows are of one part, so
    parts have about ``PART`` bytes each."""
    n = max(1, -(-size // PART))
    return materialize(reps.withColumn("part", F.spark_partition_id() % n), "texts", by="part"), n


def repeat_spans(reps: DataFrame, size: int, batch_bytes: int = BATCH) -> DataFrame:
    """(doc_id, t, a, b): bytes of the texts ``reps`` (doc_id, t, raw; about ``size`` bytes) that windows shared with a
    smaller doc_id cover.

    Equal windows have equal seeds, so all holders of a window are in one bucket. Seeds of one segment in all texts
    can't be shared, so their text is hardly ever shuffled: each part of the texts has a filter of the shared seeds that
    it has itself, so that as few others get through however many parts there are. Which buckets are heavy goes by one
    filter for all, as all of a bucket must go one way. Buckets of few segments, which fit a batch, go to tasks as
    they are. In others equal segments are combined before they are shuffled: a passage with any number of copies is
    one row in its bucket, and only its first holder is streamed against earlier ones. If different segments alone are
    more than a batch, windows are compared one by one.
    """
    spark = reps.sparkSession
    reps, parts = in_parts(reps, size)
    shared = materialize(shared_seeds(reps), "seeds")
    heavy = shared.filter(F.col("n") > min(HEAVY, batch_bytes // (MOST_WINDOWS + MATCH))).select("bucket").distinct()
    words = [spark.sparkContext.broadcast(x) for x in bit_filters(shared, "bucket", "part", parts)]
    heavy_words = spark.sparkContext.broadcast(bit_filter(heavy, "bucket"))
    light = materialize(light_spans(segments(reps, words, heavy_words, False), batch_bytes), "light")
    if heavy.isEmpty():
        return light
    cut = materialize(segments(reps, words, heavy_words, True), "segments").withColumn("sh", F.xxhash64("s"))
    distinct = materialize(cut.groupBy("bucket", "s").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).withColumn("sh", F.xxhash64("s")), "distinct")
    wide = materialize(distinct.groupBy("bucket").agg(F.sum(F.length("s")).alias("size")).filter(F.col("size") > batch_bytes).select("bucket"), "wide")
    marks = materialize(first_matches(distinct.join(wide, "bucket", "left_anti"), batch_bytes), "marks")
    found = cut.select("bucket", "sh", "doc_id", "t", "at", (F.length("s") - MATCH + 1).alias("n")).join(marks, ["bucket", "sh"]).filter("doc_id > first or mask is not null")
    return light.union(removed_spans(found)).union(wide_spans(cut.join(wide, "bucket", "left_semi")))


def without_repeats(docs: DataFrame, batch_bytes: int = BATCH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept`` (the bytes left) of every document.

    A byte goes if a ``MATCH``-byte string that covers it also starts in a document with a smaller doc_id, all judged
    on the input. Of equal texts only that with the smallest doc_id is searched: the others hold nothing new.

    Null texts are empty. Documents without a doc_id come after all others and not before each other; rows with one
    doc_id don't remove each other's bytes. An empty table gives none. Other columns are not read.
    """
    t, u = two_hashes(F.col("text"))
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"), F.coalesce(t, F.lit(0)).alias("t"), F.coalesce(u, F.lit(0)).alias("u"))
    copies = rows.groupBy("t", "u").agg(F.min("name").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select(F.col("t").alias("_t"), F.col("u").alias("_u"), "first")
    copies = materialize(copies, "copies")
    # filters are joins and not Python functions: those would be a second Python worker beside every task's
    rows = mark_maybe(rows, F.col("t"), copies, "_t", "maybe")
    joined = rows.filter("maybe").join(copies, (F.col("t") == F.col("_t")) & (F.col("u") == F.col("_u")), "left").withColumn("copy", F.coalesce(F.col("name") > F.col("first"), F.lit(False)))
    names = ["doc_id", "name", "t", "raw", "copy"]
    every = joined.select(*names).union(rows.filter("not maybe").select("doc_id", "name", "t", "raw", F.lit(False)))
    reps = every.filter("not copy").select(F.col("name").alias("doc_id"), "t", "raw")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spans = repeat_spans(reps, size, batch_bytes).groupBy("doc_id", "t").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))
    spans = materialize(spans.select(F.col("doc_id").alias("_of"), F.col("t").alias("_t"), "spans"), "spans")
    held = spans.select(F.xxhash64("_of", "_t").alias("x"))
    every = mark_maybe(every, F.xxhash64("name", "t"), held, "x", "maybe").withColumn("maybe", ~F.col("copy") & F.col("maybe"))
    with_spans = every.filter("maybe").join(spans, (F.col("name") == F.col("_of")) & (F.col("t") == F.col("_t")), "left")
    none = F.lit(None).cast(spans.schema["spans"].dataType)
    # a copy goes whole, if it has a window at all
    whole = F.when(F.col("copy") & (F.length("raw") >= MATCH), F.array(F.struct(F.lit(0).cast("long").alias("a"), F.length("raw").cast("long").alias("b"))))
    out = with_spans.select("doc_id", "raw", "spans").union(every.filter("not maybe").select("doc_id", "raw", F.coalesce(whole, none)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, 1)):
            out: list[list] = [[] for _ in range(4)]
            for raw, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                kept, end, n = [], 0, 0
                for s in found or []:
                    if s["a"] > end or not n:
                        kept.append(raw[end : s["a"]])
                        n += 1
                    end = max(end, s["b"])
                kept.append(raw[end:])
                left = b"".join(kept)
                for column, value in zip(out, (len(raw), len(raw) - len(left), n, left)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return out.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept binary")
