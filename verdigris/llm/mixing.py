"""Soft-membership mixing: domain posteriors, and document rates that meet target token totals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize
from .toxicity import labelled_sample, word_features

#: Domains by the label table: 2 * toxic + quality. Production targets are shares of the corpus's own token total.
DOMAINS = ("poor", "good", "toxic_poor", "toxic_good")
TARGETS = (0.05, 0.90, 0.01, 0.04)
FEATURES = 1 << 15
#: Passes over the posteriors, the share of all tokens by which totals may miss, and the least weight of changes.
MOST_PASSES, TOLERANCE, RIDGE = 40, 1e-6, 1e-9


def domain_model(docs: DataFrame, labels: DataFrame):
    """Multinomial logistic regression on hashed words, from at most ``MOST_LABELS`` labelled rows; None without any."""
    rows = labelled_sample(docs, labels.select("doc_id", "quality", "toxic"))
    rows = word_features(rows, "text", FEATURES).select("features", (2 * F.col("toxic") + F.col("quality")).cast("double").alias("domain"))
    # the fit goes through the rows more than once; their texts are found and hashed once
    rows = materialize(rows, "labelled")
    if rows.select("domain").distinct().count() < 2:
        return None
    return LogisticRegression(labelCol="domain", family="multinomial", maxIter=40, regParam=1e-3, standardization=False).fit(rows)


def posteriors(docs: DataFrame, model, p: str, tokens: str, unread: Sequence[str] = ()) -> DataFrame:
    """``docs``, but for the columns ``unread``, with ``tokens`` (words of the text) and ``p``, the array of domain
    posteriors; even without a model."""
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("double")
    rows = docs.withColumn(tokens, words)
    k = len(DOMAINS)
    if model is None:
        return rows.withColumn(p, F.array(*[F.lit(1.0 / k)] * k)).drop(*unread)
    (name,) = fresh(["text", "words", "features", "rawPrediction", "probability", "prediction"], "own")
    # the model's columns come and go beside a struct of the document's own, so their names can't clash
    kept = [c for c in rows.columns if c not in unread]
    own = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias(name), F.col("text"))
    got = model.transform(word_features(own, "text", FEATURES)).select(name, vector_to_array("probability").alias("got"))
    # labels that the training rows lack have no column
    full = F.concat("got", F.array_repeat(F.lit(0.0), k - model.numClasses)) if model.numClasses < k else F.col("got")
    return got.select(*[F.col(f"{name}.`{c}`").alias(c) for c in kept], full.alias(p))


def rate(p: Column, direction: Sequence[float]) -> Column:
    """A document's rate: 1 less a gradient step, the inner product of ``direction`` with its posteriors, projected on
    the nonnegative rates. The direction is one array, which Spark hands to compiled code, so that all passes share that code."""
    terms = F.zip_with(p, F.array(*[F.lit(float(x)) for x in direction]), lambda a, b: a * b)
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))


def fit_rates(rows: DataFrame, p: str, tokens: str, targets: Sequence[float] = TARGETS) -> tuple[np.ndarray, bool]:
    """The gradient direction whose projected rates r bring ``sum r * tokens * p[k]`` to ``targets[k] * sum tokens``, and
    whether its gaps are within ``TOLERANCE`` after at most ``MOST_PASSES``.

    Least squares over r >= 0: the squared gaps to the targets, and with a weight (``RIDGE``, reached in steps of ten)
    that leaves the gaps under ``TOLERANCE`` where rates can meet the targets, the squared changes of rates by tokens.
    At its optimum a rate is the projection of 1 less its inner product with one direction, so this is what the steps
    improve: the gradient is the gaps, scaled by the curvature of the documents whose rates are above zero. Plain
    projected steps need hundreds of passes where targets force most rates to zero. A pass is one distributed sum of
    as many numbers as there are pairs of domains; a step that doesn't lower the dual value is cut to a quarter.
    """
    k = len(DOMAINS)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    at = [F.get(F.col(p), F.lit(i)) for i in range(k)]

    def sums(direction: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        r, t = F.col("r"), F.col("t")
        own = rows.select(F.col(tokens).alias("t"), rate(F.col(p), direction).alias("r"), *[x.alias(f"p{i}") for i, x in enumerate(at)])
        free = F.when(r > 0, t).otherwise(0.0)
        got = own.agg(F.sum("t"), F.sum(t * r * r), *[F.sum(t * r * F.col(f"p{i}")) for i in range(k)], *[F.sum(free * F.col(f"p{i}") * F.col(f"p{j}")) for i, j in pairs]).first()
        values, gram = [v or 0.0 for v in got], np.zeros((k, k))
        for (i, j), v in zip(pairs, values[2 + k :]):
            gram[i, j] = gram[j, i] = v
        return values[0], values[1], np.array(values[2 : 2 + k]), gram

    at_now, passes = np.zeros(k), 1
    total, squares, have, gram = sums(at_now)
    if total <= 0:
        return at_now, True
    want, ridge = np.array(targets) / sum(targets) * total, 0.1
    while True:
        gradient = want - have + ridge * total * at_now
        if ridge == RIDGE and np.abs(gradient).max() <= TOLERANCE * total:
            return at_now, True
        step = -np.linalg.solve(gram + ridge * total * np.eye(k), gradient)
        dual = lambda squares, x: squares / 2 + want @ x + ridge * total / 2 * (x @ x)
        most, size = dual(squares, at_now) + 1e-12 * total, 1.0
        while True:
            if passes == MOST_PASSES:
                return at_now, False
            tried = at_now + size * step
            _, *got = sums(tried)
            passes += 1
            if dual(got[0], tried) <= most + 1e-4 * size * (gradient @ step):
                break
            size /= 4
        at_now, (squares, have, gram), ridge = tried, got, max(ridge / 10, RIDGE)


def mixed(docs: DataFrame, labels: DataFrame, targets: Sequence[float] = TARGETS, unread: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """``docs`` with (names that are returned too) tokens, posteriors, rate, copies and
    converged: whether rates meet the targets. Columns ``unread`` are not needed further on, so they are not written.

    ``copies`` is the rate rounded up or down by a hash of doc_id, so that its expectation is the rate. Null and empty
    texts have no tokens and the posteriors of a text without words. Equal texts have equal rates, and repeated rows
    of a doc_id equal copies. Rates are all 1 in a table without words. Other columns pass through.
    """
    names = fresh(docs.columns, "n_tokens", "posteriors", "rate", "copies", "converged")
    tokens, p, r, copies, converged = names
    rows = materialize(posteriors(docs, domain_model(docs, labels), p, tokens, unread), "posteriors")
    direction, met = fit_rates(rows, p, tokens, targets)
    rows = rows.withColumn(r, rate(F.col(p), direction)).withColumn(converged, F.lit(met))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col("doc_id")), 11) * F.lit(2.0**-53)
    return rows.withColumn(copies, F.floor(F.col(r) + unit).cast("int")), names


def mix(docs: DataFrame, labels: DataFrame, targets: Sequence[float] = TARGETS) -> DataFrame:
    """The documents, each as often as its copies say."""
    rows, (_, _, _, copies, _) = mixed(docs, labels, targets)
    rows = rows.filter(F.col(copies) > 0).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def rates(docs: DataFrame, labels: DataFrame, targets: Sequence[float] = TARGETS) -> DataFrame:
    """doc_id, n_tokens, a posterior for each domain, rate, copies and converged of every document."""
    rows, (tokens, p, r, copies, converged) = mixed(docs.select("doc_id", "text"), labels, targets, ("text",))
    return rows.select("doc_id", F.col(tokens).cast("long").alias("n_tokens"), *[F.get(p, F.lit(i)).alias(f"p_{d}") for i, d in enumerate(DOMAINS)], F.col(r).alias("rate"), F.col(copies).alias("copies"), F.col(converged).alias("converged"))
