"""Quality statistics and robust multivariate outliers, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import fresh, materialize

#: White space between words, what counts as symbols, as marks (with punctuation) and as capitals.
SPACE, WORD, SYMBOLS, MARKS, UPPER = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", r"[#*$%&|<>]", r"[\p{P}\p{S}]", "[A-Z]"
#: The transformed statistics: those that vary in ordinary prose. Repeated lines and words are not among them: nearly all
#: documents have none, so any would be beyond all bounds; base rules and line dedup see to these.
STATISTICS = ("z_word", "z_mark", "z_upper")
#: Share of a group's different vectors in the determinant's subset, and that within which the last step takes rows.
SUBSET, INNER = 0.75, 0.975
#: The squared distance beyond which a document is rejected: ten robust deviations. Short texts have heavy tails; by
#: Chebyshev's inequality no distribution has over 3 / 100 of its rows there, and a normal one none to speak of.
CUTOFF = 100.0
#: Vectors of the language that a source's scatter is averaged with: ten for each statistic. It decides for sources of a few
#: documents and fades in others.
PRIOR = 10 * len(STATISTICS)
#: Share of a statistic's variance over all vectors that is added to singular scatters: it keeps the arithmetic defined.
RELATIVE_FLOOR = 1e-6
#: Pairs of language and source up to which their estimates are broadcast to the rows (16 MB); more are sorted with them.
FEW_GROUPS = 10_000


def chi_squared(d: int, x: float) -> float:
    """The distribution function with ``d`` degrees of freedom at ``x``."""
    k, out = 2 - d % 2, 1 - math.exp(-x / 2) if d % 2 == 0 else math.erf(math.sqrt(x / 2))
    while k < d:
        out -= (x / 2) ** (k / 2) * math.exp(-x / 2) / math.gamma(k / 2 + 1)
        k += 2
    return out


def core(d: int, share: float) -> tuple[float, float]:
    """The squared distance that holds ``share`` of a normal distribution in ``d`` dimensions, and what the variance of
    these rows must be multiplied by to be that of all."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_squared(d, mid) < share else (low, mid)
    return low, share / chi_squared(d + 2, low)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the base statistics n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every whole
    text, and n_marks and n_upper, for the transformed ones. Null counts as a text without words. One projection
    after another over the same row: no shuffle."""
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    rows = rows.select(*keep, F.array_remove(F.split("text", SPACE), "").alias("words"), lines.alias("lines"), count(F.col("text"), SYMBOLS).alias("n_symbols"), count(F.col("text"), UPPER).alias("n_upper"), count(F.col("text"), MARKS).alias("n_marks"))
    rows = rows.withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
    base = [*keep, "word_chars", "n_symbols", "n_upper", "n_marks"]
    rows = rows.select(*base, F.size("words").cast("long").alias("n_words"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    base += ["n_words", "n_dup_lines"]
    for step in (1, 2, 4):  # hashes of windows of 2, 4 and 8 words from those of half as many
        n = F.greatest(F.size("h") - step, F.lit(0))
        rows = rows.select(*base, F.zip_with(F.slice("h", F.lit(1), n), F.slice("h", F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b)).alias("h"))
    rows = rows.select(*base, F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))).alias("h"))
    near = lambda x, i: (F.get("h", i - 1)["h"].eqNullSafe(x["h"])) | (F.get("h", i + 1)["h"].eqNullSafe(x["h"]))
    rows = rows.select(*base, F.when(F.col("h").isNotNull(), F.array_sort(F.transform(F.filter("h", near), lambda x: x["p"]))).alias("p"))
    start = F.struct(F.lit(0).alias("n"), F.lit(-8).alias("last"))
    covered = F.aggregate("p", start, lambda a, p: F.struct((a["n"] + F.least(F.lit(8), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return rows.select(*base, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def transformed() -> dict[str, Column]:
    """Logarithm of the mean word length, and square roots of the shares of marks and capitals, which evens out spread."""
    words, chars = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars"))
    return {"z_word": F.ln(chars / words), "z_mark": F.sqrt(F.col("n_marks") / chars), "z_upper": F.sqrt(F.col("n_upper") / chars)}


def pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(STATISTICS)) for j in range(i, len(STATISTICS))]


#: Columns of an estimate: location and scatter.
PLACE, SCATTER = [f"m_{c}" for c in STATISTICS], [f"c_{i}_{j}" for i, j in pairs()]


def factor() -> tuple[dict[tuple[int, int], Column], Column]:
    """Cholesky factor of the scatter in ``c_<i>_<j>``, and the logarithm of its determinant."""
    low: dict[tuple[int, int], Column] = {}
    for i in range(len(STATISTICS)):
        for j in range(i + 1):
            rest = F.col(f"c_{j}_{i}") - sum((low[i, k] * low[j, k] for k in range(j)), F.lit(0.0))
            # the added floor keeps a pivot over zero but for rounding
            low[i, j] = F.sqrt(F.greatest(rest, F.lit(1e-24))) if i == j else rest / low[j, j]
    return low, 2 * sum((F.ln(low[i, i]) for i in range(len(STATISTICS))), F.lit(0.0))


def with_factor(estimates: DataFrame) -> DataFrame:
    """Add the factor as ``l_<i>_<j>`` and ``det``, the logarithm of the determinant."""
    low, det = factor()
    return estimates.withColumns({f"l_{i}_{j}": c for (i, j), c in low.items()} | {"det": det})


def distance() -> Column:
    """Squared Mahalanobis distance of the statistics from an estimate with its factor, by forward substitution."""
    y: list[Column] = []
    for i, c in enumerate(STATISTICS):
        y.append((F.col(c) - F.col(f"m_{c}") - sum((F.col(f"l_{i}_{k}") * y[k] for k in range(i)), F.lit(0.0))) / F.col(f"l_{i}_{i}"))
    return sum((v * v for v in y), F.lit(0.0))


def moments(rows: DataFrame, group: list[str], scale: float, floor: list[float], others: Sequence[Column] = ()) -> DataFrame:
    """Location, scatter (times ``scale``, with ``floor`` on its diagonal), its factor, ``n`` and the aggregates ``others`` of
    each group's rows; sums are made map-side first, so a group with a third of all rows is no burden."""
    products = [F.avg(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"c_{i}_{j}") for i, j in pairs()]
    out = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in STATISTICS], *products, *others)
    central = {f"c_{i}_{j}": (F.col(f"c_{i}_{j}") - F.col(f"m_{STATISTICS[i]}") * F.col(f"m_{STATISTICS[j]}")) * scale + (floor[i] if i == j else 0.0) for i, j in pairs()}
    return with_factor(out.withColumns(central))


def least_determinants(rows: DataFrame, group: list[str], floor: list[float], subset: float = SUBSET, hint: str = "merge") -> DataFrame:
    """Minimum-covariance-determinant estimate of each ``group`` of ``rows``: location, scatter and its factor.

    From two starts, medians with deviations from them and means with the whole scatter, groups concentrate: the
    ``subset`` of rows nearest under the present estimate give the next. A step that lowers the determinant is taken,
    until none does in any group (each takes finitely many); the start with the lesser determinant counts. All groups and
    starts take a step in one job, and what reaches the driver is how many moved. ``hint``: of ``same_group``.
    """
    tried = [*group, "start"]
    rows = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    first, scale = rows.filter("start = 0"), core(len(STATISTICS), subset)[1]
    centre = first.groupBy(*tried).agg(*[F.percentile_approx(c, 0.5, 10_000).alias(f"m_{c}") for c in STATISTICS])
    spread = same_group(first, centre, tried, hint).groupBy(*tried).agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in PLACE], *[F.percentile_approx(F.abs(F.col(c) - F.col(f"m_{c}")), 0.5, 10_000).alias(f"d_{c}") for c in STATISTICS])
    scatter = {f"c_{i}_{j}": F.pow(F.col(f"d_{STATISTICS[i]}") * 1.4826, 2) + floor[i] if i == j else F.lit(0.0) for i, j in pairs()}
    medians = with_factor(spread.withColumns(scatter))
    means = moments(rows.filter("start = 1"), tried, 1.0, floor)
    kept = ["n", *PLACE, *SCATTER, *[f"l_{i}_{j}" for i in range(len(STATISTICS)) for j in range(i + 1)], "det"]
    names = [*tried, *kept]
    # a start's own determinant is that of no subset, so the first step is always taken
    now = materialize(medians.select(*names).union(means.select(*names)).withColumn("det", F.lit(float("inf"))), "estimates")
    # groups carry their estimate through both aggregates: every further join would be a broadcast and a plan of the driver
    was = {c: f"was_{c}" for c in kept}
    carried = [F.first(c).alias(c) for c in was.values()]
    while True:
        old = now.withColumnsRenamed(was).withColumns({c: F.col(was[c]) for c in kept if c not in ("n", "det")})
        cut = same_group(rows, old, tried, hint).groupBy(*tried).agg(F.percentile_approx(distance(), subset, 10_000).alias("cut"), *carried)
        cut = cut.withColumns({c: F.col(was[c]) for c in kept if c not in ("n", "det")})
        near = same_group(rows, cut, tried, hint).filter(distance() <= F.col("cut")).select(*tried, *STATISTICS, *was.values())
        found = moments(near, tried, scale, floor, carried).withColumn("moved", F.col("det") < F.col("was_det") - 1e-9)
        seen = Observation()
        step = found.select(*tried, *[F.when(F.col("moved"), F.col(c)).otherwise(F.col(was[c])).alias(c) for c in kept], "moved")
        now = materialize(step.observe(seen, F.count_if("moved").alias("moved")).drop("moved"), "estimates")
        if not seen.get["moved"]:
            break
    best = now.groupBy(*group).agg(F.min(F.struct("det", "start", *[c for c in names if c not in (*tried, "det")])).alias("best"))
    return best.select(*group, *[f"best.{c}" for c in names if c not in tried])


def covariance_estimates(rows: DataFrame) -> DataFrame:
    """Location and factor of the scatter for each lang and source of ``rows`` (lang, source and the statistics).

    Different vectors count once, so a group of copies of any size is one point. Each source's and each language's
    estimate has the least determinant of a subset, then takes all rows that lie within the ``INNER`` share of a normal core
    of it. A source's scatter is the average of its own and, with the weight of ``PRIOR`` vectors, its language's.
    """
    vectors = materialize(rows.distinct(), "vectors")
    whole = vectors.agg(F.approx_count_distinct(F.struct("lang", "source")).alias("groups"), *[F.var_pop(c).alias(c) for c in STATISTICS]).first()
    hint = "broadcast" if whole["groups"] <= FEW_GROUPS else "merge"
    floor = [RELATIVE_FLOOR * (whole[c] or 0.0) + 1e-18 for c in STATISTICS]
    levels = vectors.withColumn("level", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("source", F.when(F.col("level") == 0, F.col("source")))
    group = ["level", "lang", "source"]
    bound, scale = core(len(STATISTICS), INNER)
    near = same_group(levels, least_determinants(levels, group, floor, hint=hint).drop("n"), group, hint).filter(distance() <= bound).select(*group, *STATISTICS)
    found = materialize(moments(near, group, scale, floor), "estimates")
    own = found.filter("level = 0").select("lang", "source", "n", *PLACE, *SCATTER)
    of_lang = found.filter("level = 1").select("lang", *[F.col(c).alias(f"lang_{c}") for c in SCATTER])
    both = same_group(own, of_lang, ["lang"], hint)
    both = both.withColumns({c: (F.col("n") * F.col(c) + PRIOR * F.col(f"lang_{c}")) / (F.col("n") + PRIOR) for c in SCATTER})
    return with_factor(both.select("lang", "source", *PLACE, *SCATTER)).drop(*SCATTER, "det")


def same_group(rows: DataFrame, groups: DataFrame, group: list[str], hint: str) -> DataFrame:
    """``rows`` with the columns of their group; null names are names. ``hint`` says how ``groups`` is joined: left to
    itself, Spark takes rows exploded by level and start for as small as the vectors' table, and would broadcast these."""
    taken = {g: f"_of_{g}" for g in group}
    side = groups.withColumnsRenamed(taken)
    on = [F.col(g).eqNullSafe(F.col(taken[g])) for g in group]
    return rows.join(side.hint(hint), on).drop(*taken.values())


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance and kept.

    ``kept`` is false if the base rules fail, else whether the document's transformed statistics lie within the cutoff
    of the minimum-covariance-determinant estimate for its language and source, fitted on the different vectors of that
    group's documents that pass the base rules. Null and empty texts have no words and fail. Null languages and sources are groups of
    their own. Repeated rows count as often as they are there; an empty table gives none; other columns are not read.
    """
    return judged(docs, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")


def judged(docs: DataFrame, names: list[str]) -> DataFrame:
    """The columns of ``quality`` for every row, with the columns ``names``, lang and source."""
    keep = [*names, "lang", "source"]
    stats = statistics(docs.select(*keep, "text"), keep)
    stats = stats.withColumn("base_failed", base_failed()).withColumns(transformed())
    return verdicts(materialize(stats.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *STATISTICS), "statistics"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns, whatever their names. Rows without words and with a null
    text go; null languages and sources are groups of their own; repeated rows stay or go together; an empty table gives none."""
    t, own, *of = fresh(docs.columns, "_text_hash", "_t", "_of_doc_id", "_of_lang", "_of_source")
    good = judged(docs.select("doc_id", "text", "lang", "source", F.xxhash64("text").alias(t)), ["doc_id", t]).filter("kept")
    on = ["doc_id", "lang", "source"]
    good = good.select(F.col(t).alias(own), *[F.col(c).alias(x) for c, x in zip(on, of)]).distinct()
    same = [F.col(c).eqNullSafe(F.col(x)) for c, x in zip(on, of)]
    return docs.withColumn(t, F.xxhash64("text")).join(good, [F.col(t) == F.col(own), *same], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def verdicts(stats: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``stats`` with distance and kept. A group without a document that passes the base rules has no estimate, and no
    document to judge."""
    group = ["lang", "source"]
    estimates = covariance_estimates(stats.filter("not base_failed").select(*group, *STATISTICS))
    rows = stats.join(estimates.withColumnsRenamed({g: f"_of_{g}" for g in group}), [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group], "left")
    rows = rows.withColumn("distance", distance())
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= cutoff))
