"""Conversation prefix trie by smallest-member ownership."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parallelism

#: Conversations that share a first part, and the number of lengths that this part may have.
FAMILY, LENGTHS = 100, 6
#: Turns of a path, and ids of a list, that are worked on as one block.
BLOCK = 4096


def placed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, p, h1, h2, chars) of every turn: its place p in its conversation (from 1), hashes of role and text, and
    code points of the text. Turns are in order of turn (null first), then role, then text.

    Rows are dealt by ranges of that order, and a row's number in the table tells equal rows apart, so a conversation
    with a third of all rows spreads over many tasks. Each task counts on from batch to batch; what a conversation has
    in earlier ranges, at most as many numbers as there are ranges, is added after.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    rows = rows.repartitionByRange(parallelism(rows.sparkSession), *order).sortWithinPartitions(*order)
    rows = rows.select("conv_id", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("second"), "role", "text").alias("h2"), F.length("text").cast("long").alias("chars"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            starts = np.concatenate(([0], np.flatnonzero(np.diff(conv)) + 1))
            place = np.arange(1, len(conv) + 1) - np.repeat(starts, np.diff(np.append(starts, len(conv))))
            if conv[0] == last:
                place[: starts[1] if len(starts) > 1 else len(conv)] += seen
            last, seen = conv[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(conv), part, np.int32)), pa.array(place), *batch.columns[1:]], names=["conv_id", "part", "p", "h1", "h2", "chars"])

    placed = materialize(rows.mapInArrow(count, "conv_id long, part int, p long, h1 long, h2 long, chars long"), "turns")
    sizes = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.sum("n").over(before)).filter("before > 0").drop("n")
    return placed.join(sizes, ["conv_id", "part"], "left").select("conv_id", (F.col("p") + F.coalesce("before", F.lit(0))).alias("p"), "h1", "h2", "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, n, depth, h1, h2, chars) of rebuilt conversations of n turns: the first h turns of the family's first
    conversation, then one's own after the first h; and a row at depth 0, without hashes, for each."""
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(LENGTHS))
    convs = lengths.select("conv_id", F.col("n").alias("own"), h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    held = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("of_base"))
    b = F.least("h", F.coalesce("of_base", F.lit(0)))
    convs = materialize(convs.join(held, "base", "left").select("conv_id", "base", "h", b.alias("b"), (b + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "conversations")
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("p") < LENGTHS)).withColumnRenamed("conv_id", "base")
    heads = heads.join(convs, "base").filter("p <= b").select("conv_id", "n", F.col("p").alias("depth"), "h1", "h2", "chars")
    own = turns.join(convs.select("conv_id", "h", "b", "n"), "conv_id").filter("p > h").select("conv_id", "n", (F.col("p") - F.col("h") + F.col("b")).alias("depth"), "h1", "h2", "chars")
    none = F.lit(None).cast("long")
    return heads.union(own).union(convs.select("conv_id", "n", F.lit(0).cast("long"), none, none, F.lit(0).cast("long")))


def paths(rows: DataFrame) -> DataFrame:
    """(conv_id, n, depth, a, b, up_a, up_b, chars, before) of every node on the paths of ``rows``: its 128 bits, those of its
    parent, and code points of its last turn and of those before.

    A node's bits are the exclusive or of hashes of (depth, turn) along its path, so blocks of a path are summed apart:
    a window sees ``BLOCK`` turns at most, and another one the totals of blocks.
    """
    rows = rows.withColumn("block", F.floor(F.col("depth") / BLOCK))
    # the root keeps zeros
    own = [F.when(F.col("depth") > 0, F.xxhash64(F.lit(k), "depth", "h1", "h2")).otherwise(F.lit(0)).alias(f"own_{k}") for k in "ab"]
    rows = rows.select("conv_id", "n", "block", "depth", "chars", *own)
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    sums = {"a": F.bit_xor("own_a"), "b": F.bit_xor("own_b"), "upto": F.sum("chars")}
    rows = rows.select("*", *[f.over(within).alias(c) for c, f in sums.items()])
    ends = rows.groupBy("conv_id", "block").agg(F.bit_xor("own_a").alias("own_a"), F.bit_xor("own_b").alias("own_b"), F.sum("chars").alias("chars"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("conv_id", "block", *[f.over(earlier).alias(f"{c}_0") for c, f in sums.items()]).filter("block > 0")
    rows = rows.join(ends, ["conv_id", "block"], "left")
    a, b, upto = (F.coalesce(f"{c}_0", F.lit(0)) for c in ("a", "b", "upto"))
    rows = rows.select("conv_id", "n", "depth", "own_a", "own_b", "chars", F.col("a").bitwiseXOR(a).alias("a"), F.col("b").bitwiseXOR(b).alias("b"), (F.col("upto") + upto - F.col("chars")).alias("before"))
    return rows.select("conv_id", "n", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("own_a")).alias("up_a"), F.col("b").bitwiseXOR(F.col("own_b")).alias("up_b"), "chars", "before")


def id_digests(ends: DataFrame) -> DataFrame:
    """(a, b, depth, ends_sha256) for each node of ``ends`` (a, b, depth, conv_id): SHA-256 of the ids in order, joined by
    commas. Ids are joined in blocks by number first, ``BLOCK`` at most, and a node's digest then runs over its blocks
    in order, so no list of ids is ever whole in memory."""
    blocks = ends.groupBy("a", "b", "depth", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    blocks = blocks.repartition(parallelism(ends.sparkSession), "a", "b", "depth").sortWithinPartitions("a", "b", "depth", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for a, b, depth, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if (a, b, depth) == now:
                    state.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = (a, b, depth), hashlib.sha256(ids.encode())
            yield digests(out)
        if now is not None:
            yield digests([(*now, state.hexdigest())])

    def digests(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["a", "b", "depth", "ends_sha256"])

    return blocks.select("a", "b", "depth", "ids").mapInArrow(run, "a long, b long, depth long, ends_sha256 string")


def owned_suffixes(rows: DataFrame) -> DataFrame:
    """(conv_id, first_owned, from_before, leaf) of conversations that own nodes of ``rows``: the depth from which on
    they are their nodes' smallest member, code points before that depth's turn, and whether the last node is owned and
    childless. A deeper node's members are among those above it, so what is owned is a suffix of the path.

    Windows mark the smallest member and the longest path in two levels: within ``BLOCK`` hashed parts of a node, then
    among the parts' smallest, so of a node that all conversations share no task sees more than a part, or one a part.
    """
    node = ["a", "b", "depth"]
    for part in ([F.pmod(F.xxhash64("conv_id"), F.lit(BLOCK))], []):
        whole = Window.partitionBy(*node, *part)
        marked = rows.withColumn("least", F.min("conv_id").over(whole)).withColumn("n", F.max("n").over(whole))
        rows = marked.filter("conv_id = least").select("conv_id", "n", *node, "before")
    return rows.groupBy("conv_id").agg(F.min("depth").alias("first_owned"), F.min("before").alias("from_before"), F.max((F.col("n") == F.col("depth")).cast("int")).alias("leaf"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every distinct
    sequence of first turns of rebuilt conversations, named by its smallest member and its depth.

    A subtree's nodes are owned by members of its top, each by one. So one group-by of paths by node sums, over members,
    the code points of occurrences less those of owned nodes from there on, flags of owned childless ends, and flags of
    an owned next node. Null roles and texts are empty; equal rows are turns of their own; a null turn comes first. Rows
    without a conv_id belong to no conversation and are left out. A conversation left without turns is a member of the
    root alone. An empty table has no nodes. Other columns are not read.
    """
    rows = materialize(paths(rebuilt(placed_turns(conversations))), "paths")
    # who owns nothing has all its turns to take off
    totals = rows.groupBy("conv_id").agg(F.sum("chars").alias("total")).join(owned_suffixes(rows), "conv_id", "left")
    own = materialize(totals.select("conv_id", "first_owned", "leaf", F.coalesce("from_before", "total").alias("bound")), "owned")
    spare = F.greatest(F.col("bound") - F.col("before"), F.lit(0))
    next_owned = (F.col("depth") + 1 >= F.col("first_owned")) & (F.col("depth") < F.col("n"))
    nodes = rows.join(own, "conv_id").groupBy("a", "b", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"), F.count(F.lit(1)).alias("n_convs"),
        F.sum(F.coalesce(next_owned, F.lit(False)).cast("long")).alias("n_children"), F.sum(F.coalesce("leaf", F.lit(0)).cast("long")).alias("n_leaves"), F.sum(spare).alias("saved_tokens"),
    )
    nodes = materialize(nodes, "nodes")
    parents = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    ends = id_digests(rows.filter("depth = n").select("a", "b", "depth", "conv_id"))
    nodes = nodes.join(parents, ["up_a", "up_b", "depth"], "left").join(ends, ["a", "b", "depth"], "left")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
