import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        turns = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append((c, len(turns)))
    names = {p: min(m)[0] for p, m in members.items()}
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaves = sum(all(n == len(q) for _, n in members[q]) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(str(c) for c in sorted(c for c, n in m if n == len(p)))
        children = sum(len(q) == len(p) + 1 for q in below)
        out.append((names[p], len(p), names[p[:-1]] if p else None, len(m), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def turns(n):
    out = []
    for c in [*range(0, n), *range(200, 200 + n), 317]:
        for t in range(c * 7 % 9):
            like = t < 2 or c % 5 == 0
            out.append((c, t, ["user", "assistant"][t % 2], f"shared {t} 東京 😀" if like else f"own {c} {t}" * (c % 4)))
    out += [(c, 0, "user", "alone") for c in (1000, 1001, 1002, 1207)]
    # nulls in every column, ties, repeated rows, and a conversation whose family's first is not there
    out += [(500, None, None, None), (500, None, "user", "b"), (500, None, "user", "a"), (500, 3, "user", None), (500, 3, "user", None), (None, 1, "user", "nobody"), (612, 1, None, ""), (612, 1, None, "")]
    return out


@pytest.mark.parametrize("block", [4096, 3])
def test_nodes_match_brute_force(spark, monkeypatch, block):
    from verdigris.llm import trie

    monkeypatch.setattr(trie, "BLOCK", block)
    data = turns(30)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    for name in ("depth", "n", "a", "b", "before", "part", "p", "h", "block", "own", "leaf", "least", "row", "base"):
        df = df.withColumn(name, F.lit("x"))
    got = sorted((tuple(r) for r in trie.prefix_trie(df).collect()), key=str)
    assert got == brute(data)


def test_long_conversation_spreads_over_ranges(spark):
    from verdigris.llm import trie

    # one conversation holds most rows, most of them equal; h is 0 for 0 and its turns stay in order
    data = [(7, 1, "user", "same")] * 300 + [(7, t, "user", f"t{t}") for t in range(2, 60)] + [(8, 1, "user", "same")]
    placed = trie.placed_turns(spark.createDataFrame(data, SCHEMA).repartition(6))
    assert sorted(r.p for r in placed.filter("conv_id = 7").collect()) == list(range(1, 359))
    got = sorted((tuple(r) for r in trie.prefix_trie(spark.createDataFrame(data, SCHEMA)).collect()), key=str)
    assert got == brute(data)


def test_empty_table_has_no_nodes(spark):
    from verdigris.llm.trie import prefix_trie

    got = prefix_trie(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got.collect() == []
