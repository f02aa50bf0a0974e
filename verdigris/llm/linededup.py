"""Line deduplication by a segment-partition edit join, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, mark_maybe, materialize, maybe_in

#: Edits of UTF-8 bytes within which lines are near, by the bytes that the shorter has at least; still shorter lines count
#: only if they are equal, as two edits make any word of four letters another.
EDITS = ((24, 2), (12, 1))
#: Lines of a key that one task compares; a larger group is compared block by block.
BLOCK = 4096
#: Kinds of characters whose counts tell most lines with a common segment apart.
COUNTED = (" ", "e", "t", "[ac]", "[io]", "[ns]", "[rh]", "[dlu]", "[A-Z]", "[0-4]", "[5-9]", "[!-/:-@]")


def cuts(edits: int) -> list[tuple[int, int, int, int]]:
    """(edits, segment, bytes that the partitioned string is shorter by, shift) of each substring that a line looks up.

    A string of m bytes is cut into ``edits + 1`` even segments. One within ``edits`` of it holds one of them unchanged
    with at most i edits before segment i and the others after it, which bounds how far it has moved. A line takes its
    own segments and those that shorter strings may have; longer ones look up the line's.
    """
    out = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            low, high = max(-i, less - (edits - i)), min(i, less + (edits - i))
            out += [(edits, i, less, shift) for shift in range(low, high + 1)]
    return out


def keyed(rows: DataFrame, names: Sequence[str], edits: Sequence[tuple[int, int]] = EDITS) -> DataFrame:
    """``names`` and ``key``, hashes of all substrings that the binary ``bytes`` of a row looks up under the bounds that may
    hold for it and a partner: under its own bound, and under the next one too while a shorter partner may be.

    A row for each line of a small table, then one short expression: that is compiled. Written out for all lines of the
    table it makes a method too long for the virtual machine to compile, and a lambda is interpreted.
    """
    tables = [cuts(most) for _, most in edits]
    fields = ("edits", "i", "less", "shift")
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(fields, row)]) for t in tables for row in t])
    sizes, size = [len(t) for t in tables], F.length("bytes")
    start, count = F.lit(sum(sizes) + 1), F.lit(0)
    for k in range(len(edits) - 1, -1, -1):
        at_least = size >= edits[k][0]
        both = at_least & (size < edits[k][0] + edits[k + 1][1]) if k + 1 < len(edits) else F.lit(False)
        start = F.when(at_least, F.lit(sum(sizes[:k]) + 1)).otherwise(start)
        count = F.when(both, F.lit(sum(sizes[k : k + 2]))).when(at_least, F.lit(sizes[k])).otherwise(count)
    m, parts, i = F.expr("length(bytes) - p.less"), F.col("p.edits") + 1, F.col("p.i")
    at = lambda i: (m * i / parts).cast("int")
    key = F.xxhash64("p.edits", "p.i", m, F.substring("bytes", at(i) + 1 + F.col("p.shift"), at(i + 1) - at(i)))
    return rows.select(*names, "bytes", F.explode(F.slice(table, start, count)).alias("p")).select(*names, key.alias("key"))


def bound(size: Column, edits: Sequence[tuple[int, int]] = EDITS) -> Column:
    """Edits within which a line of ``size`` bytes and a longer one are near."""
    out = F.lit(0)
    for least, most in reversed(edits):
        out = F.when(size >= least, F.lit(most)).otherwise(out)
    return out


def counts(line: Column) -> list[Column]:
    """How often each of ``COUNTED`` is in ``line``. An edit takes away one byte and adds one at most, so near lines
    differ by twice their edits in all of these together at most."""
    return [F.regexp_count(F.decode(line, "ISO-8859-1"), F.lit(c)) for c in COUNTED]


def common_bytes(a: Column, b: Column, ends: bool) -> Column:
    """How many bytes ``a`` and ``b`` have in common at their starts (``ends``: at their ends), by halving steps; with
    over twice 4096 some of them."""
    steps = F.array(*[F.lit(1 << i) for i in range(12, -1, -1)])

    def further(k: Column, step: Column) -> Column:
        part = lambda x: F.substring(x, F.length(x) - k - step + 1, step) if ends else F.substring(x, k + 1, step)
        return k + F.when((k + step <= F.least(F.length(a), F.length(b))) & (part(a) == part(b)), step).otherwise(F.lit(0))

    return F.aggregate(steps, F.lit(0), further)


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether binary ``a`` and ``b`` are within ``edits``, which cut out what they have in common at either end first;
    what is left is as far apart."""
    bind = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))

    def inner(s: Column) -> Column:
        cut = lambda x: F.substring(x, s["k"] + 1, F.length(x) - s["k"])
        return bind(F.struct(cut(s["a"]).alias("a"), cut(s["b"]).alias("b")), tail)

    def tail(s: Column) -> Column:
        return bind(F.struct(s["a"].alias("a"), s["b"].alias("b"), common_bytes(s["a"], s["b"], True).alias("k")), last)

    def last(s: Column) -> Column:
        cut = lambda x: F.substring(x, 1, F.length(x) - s["k"])
        return bind(F.struct(cut(s["a"]).alias("a"), cut(s["b"]).alias("b")), left)

    def left(s: Column) -> Column:
        small = F.least(F.length(s["a"]), F.length(s["b"])) <= edits
        items = lambda x: F.split(F.decode(x, "ISO-8859-1"), "")
        # so short a rest has no band: Spark's own distance of a few characters
        short = F.levenshtein(F.decode(s["a"], "ISO-8859-1"), F.decode(s["b"], "ISO-8859-1")) <= edits
        far = F.abs(F.length(s["a"]) - F.length(s["b"])) > edits
        return F.when(far, F.lit(False)).when(small, short).otherwise(edit_distance(items(s["a"]), items(s["b"]), edits) <= edits)

    return bind(F.struct(a.alias("a"), b.alias("b"), common_bytes(a, b, False).alias("k")), inner)


def edit_distance(a: Column, b: Column, edits: int) -> Column:
    """``banded`` of arrays ``a`` and ``b``, which a lambda binds, so that they are made once and not for each item."""
    return F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda s: banded(s["a"], s["b"], edits)), F.lit(0))


def banded(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of arrays ``a`` and ``b`` of over ``edits`` items whose sizes differ by ``edits`` at most; exact up
    to ``edits``, else larger than that.

    The band of ``2 * edits + 1`` diagonals is one word: bit k stands for row j - edits + k of column j, and a column is
    a dozen bit operations. The lowest diagonal's value is kept until it meets the last row, then that row's.
    """
    width = 2 * edits + 1
    full, last = (1 << width) - 1, F.size(a)
    flip = lambda x: x.bitwiseXOR(F.lit(full))
    bit = lambda x, k: F.shiftright(x, k).bitwiseAND(F.lit(1))

    def same(j: Column) -> Column:
        hits = [F.when((j + (k - edits - 1) >= 0) & (F.get(a, j + (k - edits - 1)) == F.get(b, j - 1)), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(width)]
        return reduce(lambda x, y: x.bitwiseOR(y), hits)

    def column(s: Column, p: Column) -> Column:
        """One column, given its matches in bits ``p['m']``."""
        m, vp, vn = p["m"], s["vp"], s["vn"]
        d = (m.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(m).bitwiseOR(vn).bitwiseAND(F.lit(full))
        return F.struct(p["j"].alias("j"), d.alias("d"), vn.bitwiseOR(flip(d.bitwiseOR(vp))).alias("hp"), d.bitwiseAND(vp).alias("hn"), s["score"].alias("score"))

    def after(s: Column) -> Column:
        j, d, hp, hn = s["j"], s["d"], s["hp"], s["hn"]
        down = F.shiftright(d, 1)
        row = last - j + edits
        # shifting by a column: the power of two of the last row's bit
        pick = F.element_at(F.array(*[F.lit(1 << k) for k in range(width)]), F.least(F.greatest(row, F.lit(0)), F.lit(width - 1)) + 1)
        level = (hp.bitwiseAND(pick) > 0).cast("int") - (hn.bitwiseAND(pick) > 0).cast("int")
        score = s["score"] + F.when(row >= width - 1, F.lit(1) - bit(d, width - 1)).otherwise(level)
        return F.struct(hn.bitwiseOR(flip(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), score.alias("score"))

    matches = F.transform(F.sequence(F.lit(1), F.size(b)), lambda j: F.struct(j.alias("j"), same(j).alias("m")))
    start = F.struct(F.lit(full & ~((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("score"))
    # the inner transform binds what a column's step uses more than once
    step = lambda s, p: F.get(F.transform(F.array(column(s, p)), after), F.lit(0))
    return F.aggregate(matches, start, step, lambda s: s["score"])


def near_later(classes: DataFrame, rows: DataFrame, edits: Sequence[tuple[int, int]] = EDITS, block: int = BLOCK) -> DataFrame:
    """(h, g) of those ``classes`` (h, g, first) of equal lines to which a class with a smaller ``first`` is near.

    Every line of ``rows`` (h, g, bytes; lines may repeat) is under the hashes of the substrings that it looks up. Each
    key's least and largest line are found first, combined before the shuffle, and only keys of two lines or more are
    listed with their members. A member needs to know only whether some earlier one is near, so its key is searched by
    a semi-join, which ends at the first one: a group of any number of near lines gives one row a line, never its pairs.
    Counts of characters, which differ little in a near pair and much in others, come before the distance. A key beyond
    ``block`` lines is cut into blocks by a hash of the earlier lines, so no task holds all of them.
    """
    least = min(n for n, _ in edits)
    long = rows.filter(F.length("bytes") >= least)
    slim = keyed(long, ["h"], edits)
    shared = materialize(slim.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a < b").select("key"), "shared")
    listed = maybe_in(keyed(long, ["h", "g"], edits), F.col("key"), shared, "key")
    found = listed.join(shared, "key").distinct()
    found = materialize(found, "members")
    members = found.select("h", "g").distinct()
    # texts and places once a line, not once a key
    texts = maybe_in(long, F.col("h"), members, "h").groupBy("h", "g").agg(F.first("bytes").alias("bytes"))
    texts = maybe_in(classes.select("h", "g", "first"), F.col("h"), members, "h").join(texts, ["h", "g"])
    texts = materialize(texts.select("h", "g", F.struct("first", F.array(*counts(F.col("bytes"))).alias("p"), "bytes").alias("x")), "texts")
    parts = found.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")).filter("parts > 1")
    parts = materialize(parts, "parts")
    lines = found.join(parts, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).join(texts, ["h", "g"])
    later = lines.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.xxhash64("key", "part").alias("cell"), "h", "g", "x")
    part = F.pmod(F.xxhash64("h", "g"), F.col("parts")).cast("int")
    earlier = lines.select(F.xxhash64("key", part).alias("_cell"), F.col("x").alias("y"))
    size, other = F.length("x.bytes"), F.length("y.bytes")
    most = bound(F.least(size, other), edits)
    apart = sum((F.abs(F.get("x.p", F.lit(i)) - F.get("y.p", F.lit(i))) for i in range(len(COUNTED))), F.lit(0))
    near = F.lit(False)
    for _, k in edits:
        near = F.when(most == k, within(F.col("x.bytes"), F.col("y.bytes"), k)).otherwise(near)
    on = (F.col("cell") == F.col("_cell")) & (F.col("y.first") < F.col("x.first")) & (F.abs(size - other) <= most) & (apart <= 2 * most) & near
    return later.join(earlier, on, "left_semi").select("h", "g").distinct()


def line_rows(docs: DataFrame) -> DataFrame:
    """(place, h, g, bytes) of each line with a word: its place in the corpus and 128 bits of hash."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.filter(F.rlike("line", F.lit(r"[^\x20\x09-\x0D]")))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "pos", "t")
    return rows.select(place.alias("place"), F.xxhash64("line").alias("h"), F.xxhash64(F.lit("second"), F.col("line")).alias("g"), F.col("line").cast("binary").alias("bytes"))


def duplicate_lines(docs: DataFrame, edits: Sequence[tuple[int, int]] = EDITS) -> DataFrame:
    """(doc_id, t, pos, near): the lines of ``docs`` that an equal or near line precedes; ``near``: only a near one.

    Lines are shuffled as hashes and places. Their texts are read again where they are needed, for the members of
    shared keys. If a line near to a class comes before its first place, it comes before all of them.
    """
    rows = line_rows(docs)
    classes = materialize(rows.groupBy("h", "g").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")), "lines")
    near = near_later(classes, rows.select("h", "g", "bytes"), edits).withColumn("near", F.lit(True))
    fates = classes.join(near, ["h", "g"], "left").filter("n > 1 or near").select("h", "g", "first", F.coalesce("near", F.lit(False)).alias("near"))
    fates = materialize(fates, "fates")
    hit = maybe_in(rows.select("place", "h", "g"), F.col("h"), fates, "h").join(fates, ["h", "g"])
    return hit.filter((F.col("place") > F.col("first")) | F.col("near")).select("place.doc_id", "place.t", "place.pos", (F.col("place") == F.col("first")).alias("near"))


def dedup_lines(docs: DataFrame, edits: Sequence[tuple[int, int]] = EDITS) -> DataFrame:
    """``docs`` without the lines that come before: in a document with a smaller doc_id, or earlier in their own.

    A line goes if an equal line, or one within the edits of UTF-8 bytes that ``edits`` allows the shorter of both, has a
    smaller (doc_id, line number); whether that line stays itself makes no difference. Lines without words stay.
    ``text`` becomes the lines left, and n_lines, n_equal and n_near are added: all lines, and those removed.

    Null texts stay null and have no lines. Documents without a doc_id come after all others. Repeated rows have the
    same places, so they lose the same lines, and rows with one doc_id are ordered by line number, then text hash. An
    empty table gives none. Other columns pass through; n_lines, n_equal and n_near replace columns with these names.
    """
    docs = docs.drop("n_lines", "n_equal", "n_near")
    t, gone, row, of, own = fresh(docs.columns, "t", "gone", "row", "_of", "_text")
    hits = duplicate_lines(docs.select("doc_id", "text"), edits).distinct()
    hits = hits.groupBy("doc_id", "t").agg(F.collect_list(F.struct("pos", "near")).alias("gone"))
    hits = materialize(hits.select(F.col("doc_id").alias(of), F.col("t").alias(own), F.col("gone").alias(gone)), "removed")
    rows = docs.withColumn(t, F.xxhash64("text"))
    # only documents that may lose lines go through the join
    rows = mark_maybe(rows, F.xxhash64("doc_id", t), hits.select(F.xxhash64(of, own).alias("x")), "x", row)
    joined = rows.filter(row).join(hits, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(t) == F.col(own)), "left").drop(of, own)
    rows = joined.unionByName(rows.filter(~F.col(row)).withColumn(gone, F.lit(None).cast(hits.schema[gone].dataType)))
    lines, at = F.split("text", "\n"), F.transform(gone, lambda x: x["pos"])
    near = F.coalesce(F.size(F.filter(gone, lambda x: x["near"])), F.lit(0))
    total = F.coalesce(F.size(gone), F.lit(0))
    kept = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(at, i)), "\n"))
    counts = {"n_lines": F.coalesce(F.size(lines), F.lit(0)), "n_equal": total - near, "n_near": near}
    counts = {k: F.when(F.col("text").isNull(), F.lit(0)).otherwise(v).cast("long").alias(k) for k, v in counts.items()}
    return rows.select(*[kept.alias("text") if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns], *counts.values())
