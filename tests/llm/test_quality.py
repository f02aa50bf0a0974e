import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from . import cases


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_statistics_match_brute_force(spark):
    from verdigris.llm.quality import quality

    phrase = cases.prose(5, 12)
    data = cases.rows() + [(900, f"{phrase} x {phrase} y z {phrase}", "en", "s1", 9), (901, "a b\na b\n\n \na b\r\n", "en", "s1", 9), (902, "la " * 400, "de", "s1", 9), (903, "😀# $é|\n" * 9, "de", "s1", 9)]
    got = quality(cases.clashing(cases.table(spark, data))).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((str(r.doc_id), *[r[n] for n in names]) for r in got) == sorted((str(x[0]), *slow(x[1])) for x in data)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept is not None and not (r.base_failed and r.kept)
    assert quality(cases.table(spark, [])).collect() == []


def test_outliers_of_their_group_go(spark):
    from verdigris.llm.quality import quality

    data = [(i, cases.prose(i, 150), ["en", None][i % 2], ["s0", None][i // 2 % 2], 1) for i in range(200)]
    data += [(1000 + i, cases.prose(500 + i, 150).replace(" ", "### "), "en", "s0", 1) for i in range(12)]
    data += [(2000 + i, cases.prose(700 + i, 150).upper(), None, None, 1) for i in range(9)]
    kept = {r.doc_id: r.kept for r in quality(cases.table(spark, data)).collect()}
    assert all(kept[i] for i in range(200)) and not any(v for k, v in kept.items() if k >= 1000)


def scatter(x, d=3):
    low = np.array([[x[f"l_{i}_{j}"] if j <= i else 0.0 for j in range(d)] for i in range(d)])
    return low @ low.T


def test_estimate_resists_contamination(spark):
    """A fifth of far-off rows moves neither centre nor scatter, unlike the plain estimates."""
    from verdigris.llm.quality import STATISTICS, covariance_estimates

    rng = np.random.default_rng(0)
    core = rng.multivariate_normal(np.zeros(3), np.diag([1.0, 4, 9]) + 0.5, 2000)
    junk = rng.normal(30, 1, (500, 3))
    rows = spark.createDataFrame([("g", "s", *map(float, x)) for x in np.concatenate((core, junk))], ["lang", "source", *STATISTICS])
    (r,) = covariance_estimates(rows).collect()
    assert max(abs(r[f"m_{n}"]) for n in STATISTICS) < 0.3
    want = np.cov(core.T)
    assert np.abs(scatter(r) - want).max() < 0.12 * want.max()


def concentrated(x, subset, scale, floor):
    """The least determinant by concentration from two starts, step by step."""
    k, best = int(np.ceil(subset * len(x))), None
    order = lambda v: np.sort(v, axis=0)[int(np.ceil(0.5 * len(v))) - 1]
    m0 = order(x)
    for m, c in ((m0, np.diag((order(abs(x - m0)) * 1.4826) ** 2 + floor)), (x.mean(0), np.cov(x.T, ddof=0) + np.diag(floor))):
        last = np.inf
        while True:
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            near = x[d <= np.sort(d)[k - 1]]
            m2, c2 = near.mean(0), np.cov(near.T, ddof=0) * scale + np.diag(floor)
            det = np.linalg.slogdet(c2)[1]
            if not det < last - 1e-9:
                break
            m, c, last = m2, c2, det
        if best is None or last < best[0]:
            best = last, m, c
    return best


def test_least_determinant_matches_brute_force(spark):
    """Small groups: equal to a plain version, and to the least of all subsets in most of them."""
    from verdigris.llm.quality import STATISTICS, core, least_determinants

    rng, floor, groups, least = np.random.default_rng(3), [1e-9] * 3, {}, 0
    scale = core(3, 0.75)[1]
    for g in range(12):
        x = rng.normal(size=(12, 3)) @ rng.normal(size=(3, 3))
        x[: g % 4] += 20
        groups[g] = x
    rows = spark.createDataFrame([(g, *map(float, v)) for g, x in groups.items() for v in x], ["g", *STATISTICS])
    for r in least_determinants(rows, ["g"], floor).collect():
        x = groups[r.g]
        det, m, c = concentrated(x, 0.75, scale, np.array(floor))
        assert np.allclose([r[f"m_{n}"] for n in STATISTICS], m, atol=1e-7) and np.allclose(scatter(r), c, atol=1e-6)
        every = min(np.linalg.slogdet(np.cov(x[list(s)].T, ddof=0) * scale)[1] for s in combinations(range(12), 9))
        least += det <= every + 1e-6
    assert least >= 8


def test_copies_do_not_narrow_a_group(spark):
    from verdigris.llm.quality import quality

    data = [(i, cases.prose(7, 150), "en", "s0", 1) for i in range(400)] + [(1000 + i, cases.prose(100 + i, 150), "en", "s0", 1) for i in range(60)]
    data += [(3000 + i, cases.prose(300 + i, 60 + i), "en", f"t{i % 9}", 1) for i in range(60)]
    assert all(r.kept for r in quality(cases.table(spark, data)).collect())


@pytest.mark.parametrize("n", [1, 2])
def test_tiny_groups(spark, n):
    from verdigris.llm.quality import quality

    assert [r.kept for r in quality(cases.table(spark, [(i, cases.prose(i, 50), "en", "s", 1) for i in range(n)])).collect()] == [True] * n


def test_a_step_joins_twice(spark, monkeypatch):
    """Every join of a step is a broadcast and a plan in the driver's memory."""
    from verdigris.llm import quality

    plans, write = [], quality.materialize
    monkeypatch.setattr(quality, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().analyzed().toString()) or write(df, name))
    rows = spark.range(400).select(F.lit("de").alias("lang"), F.lit("s").alias("source"), *[F.randn(i).alias(c) for i, c in enumerate(quality.STATISTICS)])
    quality.least_determinants(rows.localCheckpoint(), ["lang", "source"], [1e-9] * 3)
    assert len(plans) > 2 and all(p.count("Join Inner") == 2 for p in plans[1:])


@pytest.mark.parametrize("few", [10_000, 0])
def test_rows_are_never_broadcast(spark, monkeypatch, few):
    """Exploded by level and start, they are more than the small table that Spark takes them for."""
    from verdigris.llm import quality

    plans, write = [], quality.materialize
    monkeypatch.setattr(quality, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    monkeypatch.setattr(quality, "FEW_GROUPS", few)
    rows = spark.range(400).select(F.lit("de").alias("lang"), F.lit("s").alias("source"), *[F.randn(i).alias(c) for i, c in enumerate(quality.STATISTICS)])
    (r,) = quality.covariance_estimates(rows).collect()
    built = Counter(re.findall(r"Build(?:Left|Right)|SortMergeJoin", "".join(plans)))
    assert set(built) == ({"BuildRight"} if few else {"SortMergeJoin"}) and abs(r.m_z_word) < 0.3
