"""SimHash fingerprints, covering locality-sensitive hashing and components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import materialize, parallelism

BITS = 64


def shingle_hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of the ``width``-word shingles (all words if there are fewer) as rows of 8 bytes, repeats among them: ASCII
    letters in lower case, words without ASCII white space. No words: no rows."""
    words = (text or "").encode().lower().split()
    if len(words) <= width:
        raw = xxhash.xxh64_digest(b" ".join(words), seed) if words else b""
    else:
        flat = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
        digest = xxhash.xxh64_digest
        raw = b"".join([digest(flat[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())])
    return np.frombuffer(raw, np.uint8).reshape(-1, 8)


def fingerprint_of(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """SimHash of one text: a bit is set if it is in over half of the shingles' hashes, repeats counted (no words: 0)."""
    return fingerprint_of(shingle_hashes(text, width, seed))


def fingerprints(docs: DataFrame, keys: Sequence[str] = ("doc_id",), width: int = 4, seed: int = 42) -> DataFrame:
    """``keys`` and ``fingerprint`` (the 64 bits as a signed long) of every whole text. Null and empty texts: 0."""
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", fingerprint long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, width, seed) for t in batch.column(len(keys)).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*keys, "fingerprint"])

    return docs.select(*keys, "text").mapInArrow(run, schema)


def covering_masks(radius: int, bits: int = BITS, seed: int = 7) -> list[int]:
    """``2^(radius+1) - 1`` bit masks such that any ``radius`` bits are outside at least one of them.

    Each bit position gets a vector m of ``radius + 1`` bits; the mask of a nonzero vector v holds the positions with an
    odd inner product of m and v. At most ``radius`` vectors m don't span the space, so some nonzero v is orthogonal to
    all of them, and its mask holds none of their positions: two fingerprints that differ only there agree under it.
    """
    rng = np.random.default_rng(seed)
    size = radius + 1
    vectors = np.concatenate([rng.permutation(np.arange(1, 1 << size)) for _ in range(-(-bits // ((1 << size) - 1)))])[:bits]
    return [sum(1 << i for i in range(bits) if (int(vectors[i]) & v).bit_count() % 2) for v in range(1, 1 << size)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _forest(names: np.ndarray, radius: int, among: np.ndarray | None = None) -> tuple[list, list]:
    """Links within ``radius`` between the fingerprints ``names`` that join all that such steps join. Rather than all pairs, each
    fingerprint reached is compared only with those not reached yet. With ``among`` (a side for each fingerprint) only
    links between the two sides count, as each side is searched elsewhere."""
    if len(names) == 2:
        far = int(names[0] ^ names[1]) & (1 << BITS) - 1
        near = far.bit_count() <= radius and (among is None or among[0] != among[1])
        return ([int(names[0])], [int(names[1])]) if near else ([], [])
    codes, left, right, rest = names.view(np.uint64), [], [], np.argsort(names, kind="stable")
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            # as many of the front at once as keep the comparison small
            part, front = front[: max(1, 2_000_000 // len(rest))], front[max(1, 2_000_000 // len(rest)) :]
            near = np.bitwise_count(codes[part][:, None] ^ codes[rest][None, :]) <= radius
            if among is not None:
                near &= among[part][:, None] != among[rest][None, :]
            hit = near.any(axis=0)
            got = rest[hit]
            left += names[part[near.argmax(axis=0)[hit]]].tolist()
            right += names[got].tolist()
            front, rest = np.concatenate((front, got)), rest[~hit]
    return left, right


def links(classes: DataFrame, radius: int = 4, block: int = 2048, seed: int = 7) -> DataFrame:
    """Pairs (a, b) of ``classes`` (fingerprint long, distinct) whose transitive closure is that of all pairs at
    ``radius`` or fewer differing bits.

    Every fingerprint is in one bucket of each covering table, so each pair within the radius meets. A bucket of up to
    ``block`` fingerprints is searched in one task. A larger one is cut into blocks by a hash, and each pair of its
    blocks is a group of its own, so no task holds over two blocks and none is left out.
    """
    masks = F.array(*[F.lit(signed(m)) for m in covering_masks(radius, seed=seed)])
    rows = classes.select("fingerprint", F.posexplode(masks).alias("tab", "mask")).select("fingerprint", "tab", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("masked"))
    sizes = rows.groupBy("tab", "masked").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    # Spark takes the exploded rows for a table as small as that of the classes, and would broadcast them
    rows = rows.join(sizes.hint("merge"), ["tab", "masked"]).withColumn("parts", F.ceil(F.col("size") / block).cast("int"))
    mine = F.pmod(F.xxhash64("fingerprint", "tab"), F.col("parts")).cast("int")
    rows = rows.withColumn("part", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lo, hi = F.least("part", "other"), F.greatest("part", "other")
    rows = rows.select("fingerprint", "part", F.xxhash64("tab", "masked", lo, hi).alias("cell"), (lo == hi).alias("own"))
    n = parallelism(classes.sparkSession)
    rows = rows.repartition(n, "cell").sortWithinPartitions("cell")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, code, part, own in _whole_cells(batches):
            cuts = np.flatnonzero(np.diff(cell)) + 1
            left: list = []
            right: list = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)]):
                if hi - lo > 1:
                    x, y = _forest(code[lo:hi], radius, None if own[lo] else part[lo:hi])
                    left += x
                    right += y
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return rows.select("cell", "fingerprint", "part", "own").mapInArrow(search, "a long, b long").distinct()


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of the sorted batches, cut only between cells."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if cut:
            yield [c[:cut] for c in now]
        held = [c[cut:] for c in now]
    if held is not None and len(held[0]):
        yield held


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node that it reaches.

    Large-star and small-star rounds: each hangs a node's larger (then smaller) neighbours on its smallest one, until
    nothing changes. Each round's links are a written table; counts alone reach the driver.
    """
    now, last = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"), None
    for _ in range(max_rounds):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.filter("b > a").join(low, "a").select("low", "b").filter("low <> b").distinct().toDF("a", "b")
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("low"))
        small = down.join(low, "u").select(F.col("low").alias("a"), F.col("v").alias("b")).union(low.select(F.col("low").alias("a"), F.col("u").alias("b"))).filter("a <> b").distinct()
        # observed as it is written: a query of its own would be as many again in the driver's memory
        seen = Observation()
        now = materialize(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "links")
        if seen.get == last:
            break
        last = seen.get
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select("a", "a").distinct())


def near_components(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42, more: Sequence[str] = ()) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id reachable over fingerprints
    that differ in ``radius`` bits or fewer.

    Equal fingerprints are one class, searched once under the class's smallest doc_id, so a group of exact copies of
    any size is one row in the search. Null and empty texts have fingerprint 0 and are linked like others. A row whose
    doc_id is null has a fingerprint and links others like any, but never names a component; one of such rows alone has
    a null component_id.
    Repeated rows give repeated rows; an empty table gives none; other columns than ``more``, which are returned too, are not read.
    """
    marks = materialize(fingerprints(docs, ("doc_id", *more), width, seed), "fingerprints")
    classes = marks.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"))
    named = materialize(classes.select(F.col("rep").cast("long"), "fingerprint"), "classes")
    # a doc_id that is on rows with several texts names several classes, so classes are linked by fingerprint
    found = components(links(named.select("fingerprint"), radius))
    group = named.join(found, named["fingerprint"] == found["node"], "left").select(named["fingerprint"], "rep", F.coalesce("component", named["fingerprint"]).alias("component"))
    least = group.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = materialize(group.join(least, "component").select("fingerprint", "component_id"), "components")
    return marks.join(ids, "fingerprint", "left").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id", *more)
