import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from . import cases


def place(key, n):
    best = {}
    for s in range(n):
        u = ((xxhash.xxh64_intdigest(f"{key}#{s}".encode(), 42) >> 11) + 0.5) * 2.0**-53
        best[s] = (-1.0 / math.log(u), -s)
    return max(best, key=best.get)


def test_shards_match_brute_force(spark):
    from verdigris.llm.sharding import shard_documents

    got = shard_documents(cases.clashing(cases.table(spark))).collect()
    assert len(got) == len(cases.rows())
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in cases.rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        key = r.doc_id if r.doc_id is not None else "\x00null"
        assert (r.law, r.shard, r.grown_shard) == ("key", place(key, 40), place(key, 41))
        assert r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert shard_documents(cases.table(spark, [])).collect() == []


def test_shards_follow_weights(spark):
    from verdigris.llm.sharding import assign_shards

    got = assign_shards(spark.range(20000), "id", [1.0, 2.0, 5.0]).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] / 20000 for r in got}
    assert all(abs(share[s] - w / 8) < 0.015 for s, w in enumerate([1, 2, 5]))


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_every_pair_within_the_radius_agrees_under_a_mask(radius):
    from verdigris.llm.simhash import covering_masks

    masks, rng = covering_masks(radius), np.random.default_rng(1)
    assert len(masks) == 2 ** (radius + 1) - 1 and all(20 <= m.bit_count() <= 44 for m in masks)
    for _ in range(3000):
        x = sum(1 << int(i) for i in rng.choice(64, radius, replace=False))
        assert any(x & m == 0 for m in masks)


def slow_fingerprint(text):
    out, words = [], []
    for ch in text or "":
        out.append(ch.lower() if "A" <= ch <= "Z" else ch)
    for w in "".join(out).replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" "):
        words += [w] if w else []
    grams = [words[i : i + 4] for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(codes):
    names = list(codes)
    root = {x: x for x in names}
    for i, x in enumerate(names):
        for y in names[:i]:
            if (x ^ y).bit_count() <= 4:
                a, b = root[x], root[y]
                for z in names:
                    if root[z] == a:
                        root[z] = b
    return root


def check_components(spark, data):
    from verdigris.llm.simhash import near_components

    codes = [(r[0], slow_fingerprint(r[1])) for r in data]
    root = slow_components({c for _, c in codes})
    least = {}
    for i, c in codes:
        if i is not None:
            least[root[c]] = min(i, least.get(root[c], i))
    got = near_components(cases.clashing(cases.table(spark, data)))
    assert Counter(map(tuple, got.collect())) == Counter((i, f"{c:016x}", least.get(root[c])) for i, c in codes)


def test_components_match_brute_force(spark):
    check_components(spark, cases.rows())
    check_components(spark, [])


def test_large_buckets_are_searched_in_blocks(spark):
    from verdigris.llm.simhash import components, links

    rng = np.random.default_rng(3)
    codes = {int(x) for x in rng.integers(0, 1 << 62, 60)}
    for c in list(codes):
        codes |= {c ^ sum(1 << int(i) for i in rng.choice(60, 3, replace=False)) for _ in range(6)}
    root = slow_components(codes)
    got = links(spark.createDataFrame([(c,) for c in codes], "fingerprint long"), block=4)
    assert all((r.a ^ r.b).bit_count() >= 1 and root[r.a] == root[r.b] for r in got.collect())
    found = {r.node: r.component for r in components(got).collect()}
    group = defaultdict(set)
    for c in codes:
        group[root[c]].add(found.get(c, c))
    assert all(len(g) == 1 for g in group.values()) and len({next(iter(g)) for g in group.values()}) == len(group)


def test_exploded_classes_are_not_broadcast(spark, tmp_path):
    """A row for each covering table comes from a class; Spark still takes them for as small as the classes' table."""
    from verdigris.llm.simhash import links

    spark.range(2000).select(F.xxhash64("id").alias("fingerprint")).write.parquet(f"{tmp_path}/classes")
    plan = links(spark.read.parquet(f"{tmp_path}/classes"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate posexplode" in plan and "Broadcast" not in plan


def test_components_follow_a_long_chain(spark):
    from verdigris.llm.simhash import components

    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components(chain).collect()} == {0}


def test_a_row_without_a_name_bridges_two_components(spark, monkeypatch):
    from verdigris.llm import simhash
    from pyspark.sql import functions as F

    # fingerprints 4 bits apart at each step, given in place of the texts' own
    given = lambda docs, keys, *_: docs.select(*keys, F.col("text").cast("long").alias("fingerprint"))
    monkeypatch.setattr(simhash, "fingerprints", given)
    docs = spark.createDataFrame([(5, "0"), (None, "15"), (9, "255"), (None, str(255 << 20))], "doc_id long, text string")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_components(docs).collect()}
    assert got == {(5, f"{0:016x}"): 5, (None, f"{15:016x}"): 5, (9, f"{255:016x}"): 5, (None, f"{255 << 20:016x}"): None}


def test_a_round_of_components_is_one_query(spark, monkeypatch):
    from verdigris.llm import simhash

    rounds, keep = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, name, **options: rounds.append(name) or keep(df, name, **options))
    store = spark._jsparkSession.sharedState().statusStore()
    for pairs in ([(i, i + 1) for i in range(9)] + [(20, 22)], []):
        edges = spark.createDataFrame(pairs, "a long, b long")
        rounds.clear()
        spark._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        before = store.executionsCount()
        found = simhash.components(edges)
        spark._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        assert store.executionsCount() - before == len(rounds)
        want = {i: 0 for i in range(10)} | {20: 20, 22: 20} if pairs else {}
        assert {r.node: r.component for r in found.collect()} == want
