import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from . import cases


def brute(rows, least, share=100, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 6):
                for i in range(len(words) - n + 1):
                    counts[lang][tuple(words[i : i + n])] += 1
    out = []
    for lang, found in counts.items():
        kept = []
        good = {g: a for g, a in found.items() if 2 <= len(g) and a >= least}
        covered = {g[i:j] for g, f in good.items() for i in range(len(g)) for j in range(i + 2, len(g) + 1) if j - i < len(g) and g[i:j] in good and 100 * f >= share * good[g[i:j]]}
        for g, a in good.items():
            if g in covered:
                continue
            score, k = min((1000 * a * totals[lang] // (found[g[:k]] * found[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), found[g[:k]], found[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def corpus(n=300):
    rng, out = random.Random(5), []
    # a language with ties, one word in every third place, and phrases that come inside longer ones alone
    vocabulary = ["the", "The", "of", "a", "zoo", "über", "東京", "😀", "x y", "İ"] + [f"w{i}" for i in range(30)]
    for i in range(n):
        words = [vocabulary[min(int(rng.expovariate(0.3)), len(vocabulary) - 1)] for _ in range(rng.randint(0, 40))]
        text = " ".join(words) + rng.choice([". ", "\t", "\r\n", " ", "!?"]) + "New York stock exchange daily" * (i % 2) + "  the  the the"
        out.append((i, text, [None, "und", "en", "de"][i % 4], "s", 0))
    out += [out[0]] * 5 + [(None, None, "en", None, None), (9, "", None, None, 0), (10, " \t\n ", "fr", None, 0), (11, "long " * 20000, "en", None, 0)]
    return out


@pytest.mark.parametrize("listed, part", [(1 << 18, 2_000_000), (3, 200), (0, 7)])
def test_phrases_match_brute_force(spark, monkeypatch, listed, part):
    from verdigris.llm import collocations as co

    # words past the list, pivots in parts, and several buckets
    monkeypatch.setattr(co, "LISTED", listed)
    monkeypatch.setattr(co, "PART", part)
    monkeypatch.setattr(co, "BUCKET", 20 * part)
    data = corpus()
    df = cases.clashing(cases.table(spark, data)).withColumns({c: F.lit("x") for c in ("word", "f", "id", "ids", "lang_", "l", "r", "n", "phrase", "rank", "count", "place")})
    got = sorted(tuple(r) for r in co.collocations(df.repartition(6), least=20).collect())
    want = brute([(r[2], r[1]) for r in data], 20)
    assert len(want) > 60 and {r[0] for r in want} >= {"und", "en", "de"}
    assert got == want


def test_share_and_top_and_empty(spark):
    from verdigris.llm import collocations as co

    data = corpus()
    got = sorted(tuple(r) for r in co.collocations(cases.table(spark, data), least=15, share=80, top=7).collect())
    assert got == brute([(r[2], r[1]) for r in data], 15, 80, 7)
    assert co.collocations(cases.table(spark, [])).collect() == []


def test_exact_beyond_64_bits(spark):
    from verdigris.llm import collocations as co

    big = 900_000_000_000_007
    words = spark.createDataFrame([("en", "a", big, 0), ("en", "b", big - 2, 1)], "lang string, word string, f long, id long")
    phrases = spark.createDataFrame([([0, 1], 800_000_000_000_003)], "ids array<long>, f long")
    totals = spark.createDataFrame([("en", 999_999_999_999_989)], "lang string, n long")
    (row,) = co.scored(phrases, words, totals).collect()
    assert row.score == 1000 * 800_000_000_000_003 * 999_999_999_999_989 // (big * (big - 2))
