import random

import pytest

from . import cases


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return not (a or b) or 5 * len(a & b) >= 4 * len(a | b)


def kept(data):
    """Index of the row of each group that stays, by all pairs."""
    sets, root = [shingles(r[1]) for r in data], list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if root[i] != root[j] and alike(sets[i], sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    groups = {}
    for i, x in enumerate(root):
        groups.setdefault(x, []).append(i)
    return [min(g, key=lambda i: (data[i][0] is None, data[i][0] or 0)) for g in groups.values()]


def edited(text, seed, places):
    words, rng = text.split(), random.Random(seed)
    for at in rng.sample(range(len(words)), places):
        words[at] = f"w{seed}x{at}"
    return " ".join(words)


def test_one_of_each_matches_brute_force_jaccard(spark, monkeypatch):
    import corpus_pipeline as P
    from verdigris.llm import neardedup, simhash

    monkeypatch.setattr(neardedup, "BLOCK", 32)
    data, far = cases.rows(14), 0
    for i in range(12):
        base = cases.prose(500 + i, 120)
        data.append((1000 + 10 * i, base, "en", "s", 1))
        for k in range(1, 5):
            data.append((1000 + 10 * i + k, edited(base, 10 * i + k, k), "en", "s", 1))
    base = cases.prose(900, 150)  # a chain of steps, with a row without a doc_id in its middle
    data += [(2000, base, "en", "s", 1), (None, edited(base, 1, 3), "en", "s", 1), (2002, edited(edited(base, 1, 3), 2, 3), "en", "s", 1)]
    common = cases.prose(901, 60)  # a passage in many documents that differ otherwise
    data += [(3000 + i, common + " " + cases.prose(4000 + i, 6 + i % 40), "en", "s", 1) for i in range(70)]
    for i, r in enumerate(data):
        for s in data[:i]:
            if r[1] and s[1] and alike(shingles(r[1]), shingles(s[1])):
                far += (simhash.fingerprint(r[1]) ^ simhash.fingerprint(s[1])).bit_count() > 4
    assert far > 5
    got = P.near_dedup(spark, cases.clashing(cases.table(spark, data)), "").collect()
    want = [data[i] for i in kept(data)]
    names = lambda x: sorted((str(r[0]), shingles(r[1]) if r[0] is None else "") for r in x)
    assert names(got) == names(want)
    assert P.near_dedup(spark, cases.table(spark, []), "").collect() == []


@pytest.mark.parametrize("n", [300, 600])
def test_pairs_stay_in_proportion_to_a_group(spark, monkeypatch, n):
    """Variants of one text, two of 120 words changed in each: a twentieth of all pairs are near, and few are listed."""
    from verdigris.llm import neardedup

    rng, rows = random.Random(3), 0

    def counted(f):
        def run(*args):
            nonlocal rows
            out = neardedup.materialize(f(*args), "listed")
            rows += out.count()
            return out

        return run

    monkeypatch.setattr(neardedup, "forest_pairs", counted(neardedup.forest_pairs))
    monkeypatch.setattr(neardedup, "meeting_pairs", counted(neardedup.meeting_pairs))
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(120))
    data = [(i, edited(base, i, 2), "en", "s", 0) for i in range(n)]
    got = neardedup.one_of_each(cases.table(spark, data).repartition(4)).collect()
    assert sorted(r.doc_id for r in got) == sorted(data[i][0] for i in kept(data))
    assert rows <= 10 * n
