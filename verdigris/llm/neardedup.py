"""Near-duplicate documents by exact Jaccard similarity of word shingles: SimHash links first, a prefix join for the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, maybe_in, parallelism
from .simhash import _whole_cells, components, fingerprint_of, links, shingle_hashes

#: Words of a shingle; documents are near from a similarity of 4/5, which ``least_common`` and ``alike`` hold in integers.
WIDTH, SEED = 5, 42
#: One document in so many is counted for shingles that are frequent, how many of these count, and members of a cell.
SAMPLE, MOST_FREQUENT, BLOCK = 16, 200_000, 1024
#: Longs of a set's sketch, and shingles at the end of a prefix by which copies meet first.
SKETCH, LASTS = 8, 2


def least_common(n: int) -> int:
    """Shingles that a set of ``n`` has in common with each set near it, at least."""
    return (4 * n + 4) // 5


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * common >= 4 * (len(a) + len(b) - common)


def sketch(own: np.ndarray) -> bytes:
    """A bit for each remainder of the hashes: whether an odd number of them has it. Two sets' sketches differ in no
    more bits than there are shingles in one of the sets alone."""
    return np.packbits(np.bincount(own & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1).tobytes()


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    return np.unique(np.ascontiguousarray(hashes).view(np.int64).ravel())


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents of a sample hold, in order, and about how many of all documents hold each. It only
    decides which shingles documents meet by, not which are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(shingle_hashes(t, WIDTH, SEED)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], names=["h"])

    sample = docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    many = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    found = many.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).select("h", (F.col("n") * SAMPLE).alias("n")).toArrow()
    keys, counts = (found[c].to_numpy().astype(np.int64) for c in ("h", "n"))
    order = np.argsort(keys)
    return keys[order], counts[order]


def marked(rows: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, k, c, fingerprint, n, prefix, sketch) of ``rows`` (doc_id, k, text): c names the set of shingles,
    ``prefix`` has as many of its ``n``, rare ones first, as hold one at least of those in common with a near set."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = shared.value
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text in batch.column(2).to_pylist():
                hashes = shingle_hashes(text, WIDTH, SEED)
                own = shingle_set(hashes)
                often = np.zeros(len(own), np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    often = np.where(keys[at] == own, counts[at], 0)
                first = own[np.lexsort((own, often))][: len(own) - least_common(len(own)) + 1]
                for column, value in zip(out, (xxhash.xxh64_intdigest(own.tobytes(), 1), fingerprint_of(hashes), len(own), first.tobytes(), sketch(own))):
                    column.append(value)
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in out[:2]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *longs, pa.array(out[2], pa.int32()), *[pa.array(x, pa.binary()) for x in out[3:]]], names=["doc_id", "k", "c", "fingerprint", "n", "prefix", "sketch"])

    return rows.select("doc_id", "k", "text").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, k long, c long, fingerprint long, n int, prefix binary, sketch binary")


def near_pairs(pairs: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b of c) whose sets are near, by the whole texts."""
    pairs = materialize(pairs.distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct().join(classes.select("c", "k"), "c")
    texts = maybe_in(rows.select("k", "text"), F.col("k"), wanted, "k").join(wanted, "k").select("c", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(shingle_hashes(t, WIDTH, SEED)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["c", "s"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [alike(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    held = materialize(texts.mapInArrow(sets, "c long, s binary").dropDuplicates(["c"]), "sets")
    both = pairs.join(held.select(F.col("c").alias("a"), F.col("s").alias("x")), "a").join(held.select(F.col("c").alias("b"), F.col("s").alias("y")), "b")
    return materialize(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "near")


def grouped(classes: DataFrame, edges: DataFrame) -> DataFrame:
    return classes.join(components(edges), F.col("c") == F.col("node"), "left").withColumn("component", F.coalesce("component", "c")).drop("node")


def forest_pairs(classes: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Pairs (a, b) of ``classes`` in different components that may be near: no more than ``LASTS`` for a class, whatever
    the size of its group.

    Copies with few changes mostly share the most frequent shingles of their prefixes, so classes meet by these alone,
    in blocks where a cell is large. In a cell a search goes from class to class as far as sketches
    and sizes allow, and lists the step by which each was reached first. It decides only which pairs are checked early.
    """
    shared = classes.sparkSession.sparkContext.broadcast(frequent)
    fields = "cell long, c long, component long, n int, " + ", ".join(f"s{i} long" for i in range(SKETCH))
    names = [x.split()[0] for x in fields.split(", ")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = shared.value
        parts_of = dict(zip(keys[counts > BLOCK].tolist(), (-(-counts[counts > BLOCK] // BLOCK)).tolist()))
        for batch in batches:
            cells, times = [], []
            for c, raw in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                own = np.frombuffer(raw, np.int64)[-LASTS:].tolist()
                cells += [xxhash.xxh64_intdigest(f"{h} {c % parts_of.get(h, 1)}") - (1 << 63) for h in own]
                times.append(len(own))
            many = [pa.array(np.repeat(batch.column(i).to_numpy(), times)) for i in range(3)]
            words = np.repeat(np.frombuffer(b"".join(batch.column(4).to_pylist()), np.int64).reshape(-1, SKETCH), times, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), *many, *map(pa.array, np.ascontiguousarray(words.T))], names=names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, c, group, n, *words in _whole_cells(batches):
            words = np.stack(words, axis=1).view(np.uint64)
            starts = np.concatenate(([0], np.flatnonzero(np.diff(cell)) + 1))
            ends = np.concatenate((starts[1:], [len(cell)]))
            some = np.minimum.reduceat(group, starts) < np.maximum.reduceat(group, starts)
            for lo, hi in zip(starts[some].tolist(), ends[some].tolist()):
                size, word = n[lo:hi], words[lo:hi]

                def near(x: np.ndarray, y: np.ndarray, size=size, word=word) -> np.ndarray:
                    apart = np.bitwise_count(word[x][:, None] ^ word[y][None, :]).sum(axis=2, dtype=np.int64)
                    return (9 * apart <= size[x][:, None] + size[y]) & (5 * np.minimum(size[x][:, None], size[y]) >= 4 * np.maximum(size[x][:, None], size[y]))

                left, right = steps(c[lo:hi], group[lo:hi], near)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], names=["a", "b"])

    rows = classes.select("c", "component", "n", "prefix", "sketch").mapInArrow(deal, fields)
    rows = rows.repartition(parallelism(classes.sparkSession), "cell").sortWithinPartitions("cell")
    return rows.mapInArrow(search, "a long, b long")


def steps(c: np.ndarray, group: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Steps of a search through the members of a cell: each reached by one to which ``near`` (of two index arrays) holds,
    unless a member of its own group was reached with it."""
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    rest = np.argsort(c)
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            part, front = front[: max(1, 500_000 // len(rest))], front[max(1, 500_000 // len(rest)) :]
            may, same = near(part, rest), group[part][:, None] == group[rest]
            step = may.any(axis=0) & ~same.any(axis=0)
            left.append(c[part[may.argmax(axis=0)[step]]])
            right.append(c[rest[step]])
            hit = may.any(axis=0) | same.any(axis=0)
            front, rest = np.concatenate((front, rest[hit])), rest[~hit]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def meeting_pairs(classes: DataFrame, frequent: tuple[np.ndarray, np.ndarray], every: bool) -> DataFrame:
    """Pairs (a, b) of ``classes`` in different components that may be near: ``every`` one, so all that are, or else the
    steps that join each cell's members. Near sets meet at the first shingle, in the order of the prefixes, that both have. What either set has from there on bounds the
    shingles in common, and the sketches bound those that are not; pairs beyond a bound are not listed. Cells of
    frequent shingles are cut into blocks, and each pair of blocks is a cell."""
    shared = classes.sparkSession.sparkContext.broadcast(frequent)
    fields = "cell long, c long, component long, n int, side int, rest int, " + ", ".join(f"s{i} long" for i in range(SKETCH))
    names = [x.split()[0] for x in fields.split(", ")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = shared.value
        parts_of = dict(zip(keys[counts > BLOCK].tolist(), (-(-counts[counts > BLOCK] // BLOCK)).tolist()))
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            times, sketches = [], b"".join(batch.column(4).to_pylist())
            for c, group, n, raw in zip(*[x.to_pylist() for x in batch.columns[:4]]):
                first = np.frombuffer(raw, np.int64).tolist()
                cells, sides, rest = [], [], []
                for at, h in enumerate(first):
                    parts = parts_of.get(h, 1)
                    mine = c % parts
                    for other in range(parts):
                        lo, hi = min(mine, other), max(mine, other)
                        cells.append(h if parts == 1 else xxhash.xxh64_intdigest(f"{h} {lo} {hi}") - (1 << 63))
                        sides.append(-1 if lo == hi else mine)
                        rest.append(n - at)
                times.append(len(cells))
                for column, value in zip(out, (cells, [c] * len(cells), [group] * len(cells), [n] * len(cells), sides, rest)):
                    column += value
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            words = np.repeat(np.frombuffer(sketches, np.int64).reshape(-1, SKETCH), times, axis=0)
            yield pa.RecordBatch.from_arrays([*[pa.array(x, k) for x, k in zip(out, kinds)], *map(pa.array, np.ascontiguousarray(words.T))], names=names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, c, group, n, side, rest, *words in _whole_cells(batches):
            words = np.stack(words).view(np.uint64)
            starts = np.concatenate(([0], np.flatnonzero(np.diff(cell)) + 1))
            ends = np.concatenate((starts[1:], [len(cell)]))
            some = np.minimum.reduceat(group, starts) < np.maximum.reduceat(group, starts)
            for lo, hi in zip(starts[some].tolist(), ends[some].tolist()):
                if not every:
                    size, left, sides, word = n[lo:hi], rest[lo:hi], side[lo:hi], words[:, lo:hi]

                    def near(x: np.ndarray, y: np.ndarray, size=size, left=left, sides=sides, word=word) -> np.ndarray:
                        out = (9 * np.minimum(left[x][:, None], left[y]) >= 4 * (size[x][:, None] + size[y])) & ((sides[x][:, None] < 0) | (sides[x][:, None] != sides[y]))
                        return out & (9 * np.bitwise_count(word[:, x, None] ^ word[:, None, y]).sum(axis=0, dtype=np.int64) <= size[x][:, None] + size[y])

                    a, b = steps(c[lo:hi], group[lo:hi], near)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
                    continue
                for at in range(lo, hi, BLOCK):
                    x, y = slice(at, min(hi, at + BLOCK)), slice(lo, hi)
                    near = (c[x][:, None] < c[y]) & (group[x][:, None] != group[y]) & ((side[x][:, None] < 0) | (side[x][:, None] != side[y]))
                    near &= 9 * np.minimum(rest[x][:, None], rest[y]) >= 4 * (n[x][:, None] + n[y])
                    i, j = np.nonzero(near)
                    apart = np.zeros(len(i), np.int64)
                    for word in words:
                        apart += np.bitwise_count(word[x][i] ^ word[y][j])
                    few = 9 * apart <= n[x][i] + n[y][j]
                    if few.any():
                        yield pa.RecordBatch.from_arrays([pa.array(c[x][i[few]]), pa.array(c[y][j[few]])], names=["a", "b"])

    rows = classes.select("c", "component", "n", "prefix", "sketch").mapInArrow(deal, fields)
    rows = rows.repartition(parallelism(classes.sparkSession), "cell").sortWithinPartitions("cell")
    return rows.mapInArrow(search, "a long, b long")


def one_of_each(docs: DataFrame, radius: int = 4) -> DataFrame:
    """One row of ``docs``, with all its columns, of each group of documents joined by steps of Jaccard similarity 0.8
    or more between sets of five-word shingles: the one with the smallest doc_id, and of several texts under it the one
    with the smallest hash. Rows without a doc_id give way to those with one. Texts without words are alike.

    Documents with one set are one class. SimHash links within ``radius`` bits and two rounds of steps through cells of
    shared shingles, each checked on whole sets, join most near classes with no more pairs than cells have members. The prefix join then finds every near pair of different groups, so a group that is together is not
    listed pair by pair. No pair is missed or joined by chance, but for equal 64-bit hashes.
    """
    (key,) = fresh(docs.columns, "_row_key")
    rows = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    own = rows.select("doc_id", F.col(key).alias("k"), "text")
    frequent = frequent_shingles(own)
    marks = materialize(marked(own, frequent), "marks")
    classes = materialize(marks.groupBy("c").agg(F.min("fingerprint").alias("fingerprint"), F.min("n").alias("n"), F.min("prefix").alias("prefix"), F.min("sketch").alias("sketch"), F.min("k").alias("k")), "classes")
    reps = classes.groupBy("fingerprint").agg(F.min("c").alias("rep"))
    same = classes.join(reps, "fingerprint").filter("c <> rep").select(F.col("rep").alias("a"), F.col("c").alias("b"))
    hops = links(reps.select("fingerprint"), radius)
    for end in ("a", "b"):
        hops = hops.join(reps.select(F.col("fingerprint").alias(end), F.col("rep").alias(f"_{end}")), end)
    alone = classes.withColumn("component", F.col("c"))
    near = near_pairs(same.union(hops.select("_a", "_b")).union(forest_pairs(alone, frequent)), classes, own)
    groups = materialize(grouped(classes, near), "groups")
    near = near.union(near_pairs(meeting_pairs(groups, frequent, False), classes, own))
    met = meeting_pairs(materialize(grouped(classes, near), "groups"), frequent, True)
    groups = grouped(classes.select("c"), near.union(near_pairs(met, classes, own)))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k")
    first = marks.select("doc_id", "k", "c").join(groups, "c").groupBy("component").agg(F.min(place).alias("first")).select(F.col("first.k").alias(key))
    return rows.join(first, key, "left_semi").dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])
