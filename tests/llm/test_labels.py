import random
import zlib
from collections import Counter

import numpy as np
import pytest

from . import cases


def labelled(spark, n=240):
    rng, data, marks = random.Random(4), [], []
    for i in range(n):
        words = cases.prose(i, 60).split(" ")
        bad = i % 3 == 0
        if bad:
            for k in rng.sample(range(len(words)), 4):
                words[k] = rng.choice(["vileness", "grubword", "nastily"])
        if i % 2:
            words = [w + "|" for w in words]
        data.append((i, " ".join(words), "en", "s0", 1))
        if i < 200:
            marks.append((i, int(i % 2 == 0), int(bad)))
    return data, spark.createDataFrame([*marks, (None, 1, 1), (3, None, 1), *marks[:5]], "doc_id long, quality int, toxic int")


def test_decoding_under_the_language_model(spark):
    from verdigris.llm.toxicity import language_model, restore, trigram_counts

    texts = [("stupid idiot clown pathetic worthless the cat sat on the mat " * 30)]
    counts = trigram_counts(cases.table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(9, None, None, None, None)]))
    model = language_model(counts)
    assert np.allclose(np.exp(model).sum(axis=2), 1, atol=1e-3)
    got = restore(["st00pid 1d10t cl0wn", "s t u p i d cat", "stuuuupid", "p@thet1c w.o.r.t.h.l.e.s.s", "the cat sat."], model, {})
    assert got[1:] == ["stupid cat", "stupid", "pathetic worthless", "the cat sat."] and got[0].split()[1:] == ["idiot", "clown"]


def test_every_noisy_shape_reaches_the_lattice(spark):
    from verdigris.llm.toxicity import language_model, restore, trigram_counts

    words = "stupid idiot asshole ass clown the cat sat on the mat "
    model = language_model(trigram_counts(cases.table(spark, [(1, words * 60, "en", "s", 1)])))
    noisy = ["@$$hole", "a$$", "$$tupid", "5+upid", "!diot", "(clown)", "i d 1 o t", "i  d  i\no t", "5 t u p 1 d", "s\tt u p i d cat", "the cat sat."]
    assert restore(noisy, model, {}) == ["asshole", "ass", "stupid", "stupid", "idiot", "(clown)", "idiot", "idiot", "stupid", "stupid cat", "the cat sat."]
    # no sign is left of a masked word, whatever the letters
    assert restore(["f****k"], model, {})[0].isalpha()
    assert restore(["1 2 3", "1,000"], model, {}) == ["1 2 3", "1,000"]


def test_counts_match_brute_force(spark):
    from verdigris.llm.toxicity import LETTERS, letter_codes, trigram_counts

    want = Counter()
    for r in cases.rows():
        if r[1]:
            c = [0, 0, *letter_codes(r[1]).tolist(), 0, 0]
            want.update((a * LETTERS + b) * LETTERS + d for a, b, d in zip(c, c[1:], c[2:]))
    assert {r.gram: r.n for r in trigram_counts(cases.table(spark)).collect()} == want


def test_scores_of_held_out_rows(spark):
    from verdigris.llm.toxicity import toxicity

    data, labels = labelled(spark)
    extra = [(1000, "", None, None, None), (1001, None, None, None, None), (None, "some words", "en", "s", 1)]
    got = toxicity(cases.clashing(cases.table(spark, data + extra)), labels).collect()
    assert len(got) == len(data) + 3
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    right = [(r.predicted == 1) == (r.doc_id % 3 == 0) for r in got if r.doc_id is not None and r.doc_id < 1000]
    assert np.mean(right) > 0.97
    assert toxicity(cases.table(spark, []), labels).collect() == []
    assert {r.score for r in toxicity(cases.table(spark, data[:5]), labels.limit(0)).collect()} == {0.0}


def test_rates_meet_the_targets(spark):
    from verdigris.llm.mixing import DOMAINS, TARGETS, mix, rates

    data, labels = labelled(spark)
    docs = cases.clashing(cases.table(spark, [*data, (1000, None, None, None, None), (None, "a b", None, None, None), data[0]]))
    got = rates(docs, labels).collect()
    total = sum(r.n_tokens for r in got)
    for d, t in zip(DOMAINS, TARGETS):
        assert sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got) == pytest.approx(t * total, abs=2e-6 * total)
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    kept = mix(docs, labels)
    assert kept.columns == docs.columns
    want = Counter()
    for r in got:
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in kept.collect()) == +want
    assert rates(cases.table(spark, []), labels).collect() == []
    assert len({r.rate for r in rates(cases.table(spark, data[:4]), labels.limit(0)).collect()}) == 1


def test_rates_write_no_texts_and_hash_labelled_ones_once(spark, monkeypatch):
    from verdigris.llm import mixing

    written, keep = {}, mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df, name, **options: written.setdefault(name, keep(df, name, **options)))
    docs = spark.createDataFrame([(i, f"plain words of {i}", i) for i in range(40)], "doc_id long, text string, other int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    assert mixing.rates(docs, labels).count() == 40
    assert written["labelled"].columns == ["features", "domain"] and written["labelled"].count() == 40
    assert written["posteriors"].columns == ["doc_id", "n_tokens", "posteriors"]
    written.clear()
    assert mixing.mix(docs, labels).columns == docs.columns and set(docs.columns) < set(written["posteriors"].columns)


def test_projected_steps_reach_the_constrained_optimum(spark):
    """Targets that force rates to zero, against a dense solver's projected gradient run to the end."""
    from pyspark.sql import functions as F
    from verdigris.llm.mixing import fit_rates, rate

    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.4] * 4, 300)
    t = rng.integers(1, 50, 300).astype(float)
    rows = spark.createDataFrame([(float(a), [float(x) for x in b]) for a, b in zip(t, p)], "t double, p array<double>")
    goal = np.array([0.9, 0.05, 0.03, 0.02])
    direction, converged = fit_rates(rows, "p", "t", goal)
    assert converged
    got = np.array([r[0] for r in rows.select(rate(F.col("p"), direction)).collect()])
    gap = (got * t) @ p - goal * t.sum()
    want = np.ones(300)
    gram = np.linalg.inv((p * t[:, None]).T @ p)
    for _ in range(400):
        want = np.maximum(0, want - p @ (gram @ ((want * t) @ p - goal * t.sum())))
    best = (want * t) @ p - goal * t.sum()
    assert gap @ gram @ gap <= best @ gram @ best + 1e-3 * t.sum() and (got >= 0).all() and (got == 0).any()


def test_a_character_is_coded_once(monkeypatch):
    import numpy as np
    from verdigris.llm import toxicity

    calls, code = [], toxicity.letter_codes
    monkeypatch.setattr(toxicity, "letter_codes", lambda text: calls.append(text) or code(text))
    model, known, plain = np.zeros((toxicity.LETTERS,) * 3, np.float32), {}, set()
    texts = ["z3ro w0rd plain", "w0rd, plain z3ro 0", "z 3 r o (w0rd) a b 1.", "A I a", ""]
    first = toxicity.restore(texts, model, known, plain)
    assert plain >= {"plain"} and "z3ro" in known and toxicity.restore(texts, model, known, plain) == first == [x for t in texts for x in toxicity.restore([t], model, {})]
    assert len(calls) == len(set(calls))
