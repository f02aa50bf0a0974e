"""Phrase collocations: frequent phrases mined by pivot partitioning, scored by their weakest cut."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_filter, materialize, parallelism
from .tokens import pieces

#: Words of a phrase at most, occurrences at least, phrases of a language that are returned.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Frequent words whose order by frequency is sent to all tasks, and bytes of such a word at most: 16 MB of text bound
#: it. Further frequent words count as rarer than these, in order of their hashes, and are mined like any other.
LISTED, LISTED_BYTES = 1 << 18, 64
#: Occurrences of a pivot in one part of it, and of pivots in a bucket on average.
PART = BUCKET = 2_000_000
#: ASCII letters to lower case, a tab to a space, and what ends a piece to a line feed.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
OTHER = (1 << 62) - 1


def tokens(text: str | None) -> list[bytes]:
    """Words of a whole text in order, with a line feed between pieces; empty strings stand between spaces."""
    return (text or "").encode().translate(FOLD).replace(b"\n", b" \n ").split(b" ")


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f): occurrences of every word of ``docs`` (lang, text), counted by batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1):
                counts: dict[str, Counter] = {}
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    counts.setdefault(lang, Counter()).update(tokens(text))
                for lang, found in counts.items():
                    for gap in (b"", b"\n"):
                        found.pop(gap, None)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "f"])

    return docs.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


class Words:
    """Ids of frequent words: the more frequent, the smaller. Words that are not frequent have -1, and so has a gap
    between pieces."""

    def __init__(self, listed: list[tuple[str, str]], bits: np.ndarray, start: int):
        self.start = start  # of the ids of words that are not listed
        self.ids: dict[str, dict[bytes, int]] = {}
        for i, (lang, word) in enumerate(listed):
            self.ids.setdefault(lang, {})[word.encode()] = i
        self.bits = bits

    def of(self, lang: str, words: list[bytes]) -> np.ndarray:
        own = self.ids.get(lang, {})
        if len(self.bits):  # there are frequent words that are not listed
            more = {w: self.rest(lang, w) for w in set(words) if w not in own}
            more[b"\n"] = -1
            own = more | {w: own[w] for w in set(words) if w in own}
        get = own.get
        return np.fromiter([get(w, -1) for w in words if w], np.int64)

    def rest(self, lang: str, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(lang.encode() + b" " + word, 42) & OTHER
        spot = found & (64 * len(self.bits) - 1)
        return self.start + found if int(self.bits[spot >> 6]) >> (spot & 63) & 1 else -1


def fragments(x: np.ndarray) -> np.ndarray:
    """A row for each word of the id sequence ``x`` that has a neighbour to share a phrase with, as its pivot: the pivot
    in the middle, ``LONGEST`` - 1 words either way, cut at -1, at rarer words and, before the pivot, at the pivot itself;
    -1 elsewhere. A phrase lies in the row of the first of its rarest words and in no other row."""
    reach = LONGEST - 1
    padded = np.concatenate((np.full(reach, -1), x, np.full(reach, -1)))
    shifted = lambda s: padded[reach + s : reach + s + len(x)]
    some = x >= 0
    some &= ((shifted(-1) >= 0) & (shifted(-1) < x)) | ((shifted(1) >= 0) & (shifted(1) <= x))
    at = np.flatnonzero(some) + reach
    pivot = padded[at]
    out = np.full((len(at), 2 * reach + 1), -1)
    out[:, reach] = pivot
    for side in (-1, 1):
        on = np.ones(len(at), bool)
        for step in range(1, reach + 1):
            y = padded[at + side * step]
            on &= (y >= 0) & ((y < pivot) if side < 0 else (y <= pivot))
            out[on, reach + side * step] = y[on]
    return out


def mixed_hash(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        out = (out ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def combined(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows as one, with their counts summed, and hashes of the rows. Rows under one hash are compared."""
    keys = mixed_hash(rows)
    order = np.argsort(keys)
    rows, counts, keys = rows[order], counts[order], keys[order]
    first = np.ones(len(rows), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1]).any(axis=1)
    at = np.flatnonzero(first)
    return rows[at], np.add.reduceat(counts, at) if len(at) else counts, keys[at]


def flattened(rows: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Rows as bytes: which words there are, two low bytes of each word, and the rest of it."""
    there = rows >= 0
    flat = rows[there]
    high = flat >> 16
    return np.packbits(there, axis=1).tobytes(), (flat & 0xFFFF).astype("<u2").tobytes(), high.astype("u1" if not len(high) or high.max() < 256 else "<i8").tobytes()


def restored(there: bytes, low: bytes, high: bytes) -> np.ndarray:
    width = 2 * LONGEST - 1
    mask = np.unpackbits(np.frombuffer(there, np.uint8).reshape(-1, -(-width // 8)), axis=1)[:, :width].astype(bool)
    out = np.full(mask.shape, -1)
    out[mask] = np.frombuffer(low, "<u2").astype(np.int64) | np.frombuffer(high, "u1" if 2 * len(high) == len(low) else "<i8").astype(np.int64) << 16
    return out


def parts_of(pivots: np.ndarray, many: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """In how many parts each pivot is dealt: 1, or for the frequent ones of ``many`` (ids in order, parts) several."""
    ids, parts = many
    if not len(ids):
        return np.ones(len(pivots), np.int64)
    at = np.minimum(np.searchsorted(ids, pivots), len(ids) - 1)
    return np.where(ids[at] == pivots, parts[at], 1)


def mined(rows: np.ndarray, counts: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases of two words and more that ``rows``' pivots own, as (ids, occurrences) by length and place of the pivot.
    Phrases grow from the pivot to the right and then to the left, and only from those with ``least`` (of their rows)
    occurrences: whatever holds a phrase has no more of them."""
    reach = LONGEST - 1
    codes = rows
    if len(rows) and rows.max() >= 1 << 31:
        codes = np.unique(rows, return_inverse=True)[1].reshape(rows.shape) - 1

    def grown(at: np.ndarray, group: np.ndarray, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        there = rows[at, column] >= 0
        at, group = at[there], group[there]
        _, first, group = np.unique(group << 31 | codes[at, column], return_index=True, return_inverse=True)
        sums = np.bincount(group, counts[at], len(first)).astype(np.int64)
        good = sums >= least[at[first]]
        keep = good[group]
        return at[keep], group[keep], at[first[good]], sums[good]

    at = np.arange(len(rows))
    group = np.unique(codes[:, reach], return_inverse=True)[1].astype(np.int64)
    for right in range(LONGEST):
        if right:
            at, group, seen, sums = grown(at, group, reach + right)
            yield rows[seen, reach : reach + right + 1], sums
        held, near = at, group
        for left in range(1, LONGEST - right):
            held, near, seen, sums = grown(held, near, reach - left)
            yield rows[seen, reach - left : reach + right + 1], sums


def frequent_phrases(docs: DataFrame, words: DataFrame, least: int = LEAST) -> DataFrame:
    """(ids, f) of all phrases of 2 to ``LONGEST`` words with ``least`` occurrences in ``docs`` (lang, text), from its
    frequent ``words`` (lang, word, f, id).

    Each occurrence of a frequent word routes the part of the text around it whose words are no rarer to that word's
    bucket, where what it owns is counted; equal parts of a batch are one. A pivot with over ``PART`` occurrences is dealt
    by the parts' hashes, and what these count is summed; all others are cut to ``least`` in their bucket.
    """
    spark = docs.sparkSession
    listed = words.filter(F.col("id") < LISTED).orderBy("id").select("lang", "word").toArrow()
    rest = words.filter(F.col("id") >= LISTED).select((F.col("id") - LISTED).alias("h"))
    many = words.filter(F.col("f") > PART).orderBy("id").select("id", F.ceil(F.col("f") / PART).alias("parts")).toArrow()
    many = (many["id"].to_numpy().astype(np.int64), many["parts"].to_numpy().astype(np.int64))
    bits = np.zeros(0, np.uint64) if rest.isEmpty() else bit_filter(rest, "h")
    shared = spark.sparkContext.broadcast((list(zip(*(listed[c].to_pylist() for c in ("lang", "word")))), bits, many, LISTED))
    occurrences = words.agg(F.sum("f")).first()[0] or 0
    buckets = max(parallelism(spark), -(-occurrences // BUCKET))
    fields = "bucket int, counts binary, there binary, low binary, high binary"
    names = [x.split()[0] for x in fields.split(", ")]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, bits, many, start = shared.value
        own = Words(listed, bits, start)
        for whole in batches:
            for batch in pieces(whole, 1):
                found = [own.of(lang, [*tokens(text), b"\n"]) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
                rows = fragments(np.concatenate(found))
                rows, counts, keys = combined(rows, np.ones(len(rows), np.int64))
                pivots = rows[:, LONGEST - 1]
                part = (keys >> np.uint64(8)).astype(np.int64) % parts_of(pivots, many)
                bucket = (mixed_hash(np.stack((pivots, part), axis=1)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                rows, counts, bucket = rows[order], counts[order], bucket[order]
                starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                out = [(int(bucket[lo]), counts[lo:hi].astype("<i8").tobytes(), *flattened(rows[lo:hi])) for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)])]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int32() if i == 0 else pa.binary()) for i in range(5)], names=names)

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, many, _ = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, most = 0, 2 * BUCKET

        def together() -> tuple[np.ndarray, np.ndarray]:
            return combined(*(np.concatenate(x) for x in zip(*held)))[:2]

        for batch in batches:
            for counts, there, low, high in zip(*[c.to_pylist() for c in batch.columns[1:]]):
                held.append((restored(there, low, high), np.frombuffer(counts, "<i8")))
                size += len(held[-1][1])
                if size > most:
                    held = [together()]
                    size, most = len(held[0][1]), max(most, 2 * len(held[0][1]))
        if not held:
            return
        rows, counts = together()
        bound = np.where(parts_of(rows[:, LONGEST - 1], many) > 1, 1, least)
        for ids, sums in mined(rows, counts, bound):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, ids.size + 1, ids.shape[1], dtype=np.int32)), pa.array(ids.ravel()))
            yield pa.RecordBatch.from_arrays([lists, pa.array(sums)], names=["ids", "f"])

    routed = docs.mapInArrow(route, fields).repartitionById(buckets, "bucket")
    return routed.mapInArrow(mine, "ids array<long>, f long").groupBy("ids").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def with_ids(words: DataFrame) -> DataFrame:
    """Add ``id`` to frequent words: the place among the listed by frequency, or a hash past all of these."""
    spark = words.sparkSession
    short = words.filter(F.octet_length("word") + F.octet_length("lang") <= LISTED_BYTES)
    listed = short.orderBy(F.desc("f"), "lang", "word").limit(LISTED).select("lang", "word").toArrow()
    listed = listed.append_column("place", pa.array(np.arange(listed.num_rows)))
    places = spark.createDataFrame(listed) if listed.num_rows else spark.createDataFrame([], "lang string, word string, place long")
    other = F.xxhash64(F.concat_ws(" ", "lang", "word")).bitwiseAND(F.lit(OTHER)) + LISTED
    return words.join(places, ["lang", "word"], "left").select("lang", "word", "f", F.coalesce("place", other).alias("id"))


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, ids, a, l, r, n, score) of ``phrases`` by their lowest-scoring cut, the first of several. The product of a, n
    and 1000 is a decimal of 36 digits, so nothing is rounded below 10^15 words."""
    parts = phrases.union(words.select(F.array("id"), "f"))
    cuts = phrases.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("ids", F.lit(1), F.col("k"))).withColumn("right", F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")))
    cuts = cuts.join(parts.toDF("left", "l"), "left").join(parts.toDF("right", "r"), "right")
    cuts = cuts.withColumn("id", F.get("ids", F.lit(0))).join(words.select("id", "lang"), "id").join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = cuts.withColumn("over", (wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)"))).withColumn("under", wide("l") * wide("r"))
    best = F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "ids", "a", "n").agg(best).select("lang", "ids", "a", "best.l", "best.r", "n", "best.score")


def collocations(docs: DataFrame, least: int = LEAST, share: int = 100, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's first ``top`` phrases of 2 to ``LONGEST`` words.

    Words are those of whole texts between spaces and tabs, with ASCII letters in lower case; a phrase lies within a piece
    between punctuation or line ends. a, l, r are occurrences of the phrase and of the parts of its lowest-scoring cut,
    n all words of the language, score floor(1000 * a * n / (l * r)). Phrases with under ``least`` occurrences are left
    out, and those within a longer one that has ``share`` percent of theirs: a longer phrase by one word then has too.

    A null language is ``und``; null and empty texts have no words; repeated rows count each; an empty table gives no
    rows; other columns are not read. Exact, but for equal 62-bit hashes of frequent words past the listed ones.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counts = materialize(word_counts(texts), "words")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    words = materialize(with_ids(counts.filter(F.col("f") >= least)), "frequent")
    phrases = materialize(frequent_phrases(texts, words, least), "phrases")
    size = F.size("ids")
    longer = phrases.filter(size > 2).select(F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))).alias("ids"), F.col("f").alias("of_longer"))
    longer = longer.groupBy("ids").agg(F.max("of_longer").alias("of_longer"))
    rows = scored(phrases, words, totals).join(longer, "ids", "left").filter(F.coalesce(100 * F.col("of_longer") < share * F.col("a"), F.lit(True)))
    order = [F.desc("score"), F.desc("a")]
    rows = rows.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= top)
    spelt = rows.select("*", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id")
    spelt = spelt.groupBy("lang", "ids", "a", "l", "r", "n", "score").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    spelt = spelt.withColumn("phrase", F.array_join(F.col("words.word"), " "))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")
    return spelt.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
