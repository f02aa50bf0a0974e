import random

from . import cases


def slow(data):
    first = {}
    key = lambda d: (d is None, d or 0)
    for d, text, *_ in data:
        raw = (text or "").encode()
        for i in range(len(raw) - 49):
            w = raw[i : i + 50]
            first[w] = min(first.get(w, (True, 0)), key(d))
    out = []
    for d, text, *_ in data:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if first[raw[i : i + 50]] < key(d):
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out.append((str(d), len(raw), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), kept))
    return sorted(out)


def test_matches_brute_force(spark, monkeypatch):
    from verdigris.llm import substrings

    rng, data = random.Random(6), cases.rows(24)
    whole = cases.prose(77, 400)
    for i in range(40):
        a = rng.randrange(len(whole) - 300)
        data.append((200 + i, cases.prose(300 + i, 20) + whole[a : a + rng.randint(30, 250)] + cases.prose(400 + i, 15) + whole[a + 20 : a + 75], "en", "s", 1))
    data += [(400, "ab" * 300, "en", "s", 1), (399, "ba" * 200, "en", "s", 1), (401, "é" * 60, None, None, None), (402, "x" + "é" * 50, None, None, None)]
    got = substrings.without_repeats(cases.clashing(cases.table(spark, data)))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()) == slow(data)
    assert substrings.without_repeats(cases.table(spark, [])).collect() == []


def test_large_buckets_are_dealt_on_by_windows(spark, monkeypatch):
    """One passage in many contexts: with a small bound no bucket over it may reach the index of whole buckets."""
    from verdigris.llm import substrings

    indexed, sizes, windowed = substrings.first_matches, [], []

    def watched(distinct, batch_bytes):
        sizes.extend(r.n for r in distinct.selectExpr("bucket", "length(s) n").groupBy("bucket").agg({"n": "sum"}).toDF("bucket", "n").collect())
        return indexed(distinct, batch_bytes)

    def counted(cut, by_window=substrings.wide_spans):
        windowed.append(cut.count())
        return by_window(cut)

    monkeypatch.setattr(substrings, "first_matches", watched)
    monkeypatch.setattr(substrings, "wide_spans", counted)
    passage = cases.prose(77, 30)
    data = [(i, cases.prose(300 + i, 12) + passage[:64] + cases.prose(400 + i, 12), "en", "s", 1) for i in range(80)]
    data += [(None, passage, "en", "s", 1), (None, "q" + passage, "en", "s", 1), data[3]]
    got = substrings.without_repeats(cases.table(spark, data), batch_bytes=2000).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == slow(data)
    assert max(sizes) <= 2000 and windowed[0] > 0


def test_seeds_are_counted_in_packed_rows(spark, monkeypatch):
    """Nearly all seeds are different, and each was a row of a shuffle of its own."""
    from collections import Counter

    from pyspark.sql import functions as F
    from verdigris.llm import substrings

    monkeypatch.setattr(substrings, "SORTED", 300)
    monkeypatch.setattr(substrings, "CELL_BITS", 3)
    texts = [r[1].encode() for r in cases.rows(20) if r[1]]
    want = Counter(int(x) for cut in substrings.cuts(texts) for x in cut.seed)
    got = substrings.shared_seeds(spark.createDataFrame([(t,) for t in texts], "raw binary").repartition(3))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert {r.bucket: r.n for r in got.collect()} == {k: n for k, n in want.items() if n > 1} and len(want) > 2000
    assert "counts" in plan and "Aggregate" not in plan
    none = spark.createDataFrame([(b"",), (b"x" * 49,)], "raw binary")
    assert substrings.shared_seeds(none).collect() == [] and substrings.shared_seeds(none.filter(F.lit(False))).collect() == []


def test_pieces_of_long_texts_hold_every_window_once(monkeypatch):
    from verdigris.llm import substrings

    monkeypatch.setattr(substrings, "PIECE", 512)
    texts = [cases.prose(5, 700).encode(), b"x" * 3000, b"", b"y" * 49, b"z" * 50]
    seen = sorted((int(o), int(a) + i) for cut in substrings.cuts(texts) for o, a, n in zip(cut.owner, cut.at, cut.windows) for i in range(n))
    assert seen == [(k, i) for k, t in enumerate(texts) for i in range(len(t) - 49)]


def longest(text, at, sources):
    n = 0
    while n < 64 and at + n < len(text) and any(text[at : at + n + 1] in s for s in sources):
        n += 1
    return n


def test_matching_statistics_and_runs_equal_brute_force():
    import numpy as np
    from verdigris.llm.runindex import RunIndex, suffix_array, words

    rng = random.Random(1)
    for trial in range(40):
        letters = b"ab" if trial % 2 else b"abcde"
        texts = [(g, bytes(rng.choice(letters) for _ in range(rng.randint(0, 90)))) for g in range(rng.randint(1, 4)) for _ in range(rng.randint(1, 4))]
        flat = np.frombuffer(b"".join(t + b"\xff" for _, t in texts), np.uint8)
        group = np.repeat([g for g, _ in texts], [len(t) + 1 for _, t in texts])
        places = suffix_array(flat, group, words(np.concatenate((flat, np.full(64, 255, np.uint8))))[: len(flat)])
        number = np.repeat(np.arange(len(texts)), [len(t) + 1 for _, t in texts])
        suffix = lambda i: (group[i], bytes(flat[i : i + bytes(flat[i:]).index(255) + 1]), number[i])
        assert [suffix(i) for i in places] == sorted(suffix(i) for i in range(len(flat)))
        index = RunIndex(flat, group)
        assert index.size.sum() == len(flat) and (index.first[index.size == 1] == index.last[index.size == 1]).all()
        patterns = []
        for _ in range(6):
            g = rng.choice(texts)[0]
            p = bytearray(b"".join(rng.choice([t for k, t in texts if k == g]) for _ in range(2)))
            if p:
                p[rng.randrange(len(p))] = rng.choice(b"abz")
            patterns.append((g, bytes(p)))
        sizes = np.array([len(p) for _, p in patterns])
        got = index.matching_statistics(np.frombuffer(b"".join(p for _, p in patterns), np.uint8), np.cumsum(sizes) - sizes, sizes, np.array([g for g, _ in patterns]))
        assert got.tolist() == [longest(p, i, [t for k, t in texts if k == g]) for g, p in patterns for i in range(len(p))]


def test_a_task_has_one_python_worker(spark):
    """Functions of columns would be evaluated by workers of their own, beside those of the batches."""
    from verdigris.llm import substrings

    got = substrings.without_repeats(cases.table(spark, cases.rows(24)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_buckets_are_read_as_columns():
    """Whole buckets, at least ``size`` bytes but for the last; they came as lists of Python values, row by row."""
    import numpy as np
    import pyarrow as pa
    from verdigris.llm.substrings import whole_buckets

    rng = np.random.default_rng(5)
    bucket = np.sort(rng.integers(0, 40, 300))
    strings = [bytes(rng.integers(0, 255, rng.integers(1, 9)).astype(np.uint8)) for _ in bucket]
    whole = pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(strings, pa.binary())], names=["bucket", "s"])
    for size in (0, 1, 30, 10_000):
        want, held = [], []
        for b, s in zip(bucket.tolist(), strings):
            if held and sum(len(x) for _, x in held) >= size and b != held[-1][0]:
                want.append(held)
                held = []
            held.append((b, s))
        want.append(held)
        for step in (1, 7, 300):
            got = list(whole_buckets(iter([whole.slice(0, 0), *[whole.slice(i, step) for i in range(0, 300, step)]]), size))
            assert all(isinstance(x, pa.Table) for x in got)
            assert [[*zip(x["bucket"].to_pylist(), x["s"].to_pylist())] for x in got] == want
    assert list(whole_buckets(iter([]), 10)) == []


def test_parts_have_filters_of_their_own(spark, monkeypatch):
    """A filter for all texts lets nearly all segments through once it is full; a part's holds only its own seeds."""
    from verdigris.llm import common, substrings

    data = [(i, cases.prose(600 + i, 90) + cases.prose(i // 2, 30) + cases.prose(900 + i, 90), "en", "s", 1) for i in range(160)]
    monkeypatch.setattr(common, "LEAST_BITS", 10)
    monkeypatch.setattr(common, "MOST_BITS", 10)
    monkeypatch.setattr(substrings, "PART", sum(len(r[1].encode()) for r in data) // 12, raising=False)
    spans, dealt = substrings.light_spans, []

    def watched(cut, batch_bytes):
        dealt.append(cut.count())
        return spans(cut, batch_bytes)

    monkeypatch.setattr(substrings, "light_spans", watched)
    got = substrings.without_repeats(cases.table(spark, data).repartition(24)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == slow(data)
    every = sum(len(cut.seed) for cut in substrings.cuts([r[1].encode() for r in data]))
    assert dealt[0] < 0.4 * every, (dealt, every)


def test_seeds_name_the_parts_that_have_them(spark):
    """``n`` counts all parts, and a part without the seed is not named."""
    from collections import defaultdict

    from verdigris.llm import substrings

    texts = [(k % 3, r[1].encode()) for k, r in enumerate(cases.rows(20)) if r[1]]
    n, parts = defaultdict(int), defaultdict(set)
    for part, text in texts:
        for cut in substrings.cuts([text]):
            for x in cut.seed.tolist():
                n[x] += 1
                parts[x].add(part)
    got = substrings.shared_seeds(spark.createDataFrame(texts, "part int, raw binary").repartition(2)).collect()
    assert sorted((r.part, r.bucket, r.n) for r in got) == sorted((p, x, n[x]) for x in n if n[x] > 1 for p in parts[x])


def test_segments_without_a_shared_window_are_not_indexed(monkeypatch):
    """Only segments that may match are indexed and streamed, whole buckets at a time; results equal brute force."""
    import numpy as np
    from verdigris.llm import substrings

    rng, segs = random.Random(9), []
    for b in range(60):
        seed = bytes(rng.choice(b"abcd") for _ in range(24))
        for d in range(rng.randint(1, 6)):
            side = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(26, 60))) for _ in range(2)]
            if segs and segs[-1][0] == b and b % 5 == 0:
                side = [segs[-1][3][0][-30:], segs[-1][3][1][:30]] if rng.random() < 0.6 else side
            segs.append((b, d, side[0] + seed + side[1], side))
    flat = np.frombuffer(b"".join(s[2] for s in segs), np.uint8)
    sizes = np.array([len(s[2]) for s in segs])
    starts, bucket, first = np.cumsum(sizes) - sizes, np.array([s[0] for s in segs]), np.array([s[1] for s in segs])
    want = [any(s[2][i : i + 50] in o[2] for o in segs if o[0] == s[0] and o[1] < s[1]) if i + 50 <= len(s[2]) else False for s in segs for i in range(len(s[2]))]
    indexed, index = [], substrings.RunIndex
    monkeypatch.setattr(substrings, "RunIndex", lambda text, group: indexed.append(len(text)) or index(text, group))
    assert substrings.earlier_matches(flat, starts, sizes, bucket, first).tolist() == want and any(want)
    assert sum(indexed) < len(flat) // 3
    monkeypatch.setattr(substrings, "BATCH", 300)
    del indexed[:]
    assert substrings.earlier_matches(flat, starts, sizes, bucket, first).tolist() == want and len(indexed) > 3
    assert not substrings.earlier_matches(flat[: sizes[0]], starts[:1], sizes[:1], bucket[:1], first[:1]).any()
