"""The normal distribution as columns, and order statistics of it."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The error function's rational approximation 7.1.26 of Abramowitz and Stegun.
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
EULER_GAMMA = 0.5772156649015329
#: Acklam's rational approximation of the normal quantile, numerators and denominators of middle and tails.
MIDDLE_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
MIDDLE_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
TAIL_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
TAIL_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
TAIL = 0.02425


def normal_cdf(z: Column) -> Column:
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + ERF_P * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return 0.5 * (1 + F.signum(z) * (1 - poly * F.exp(-x * x)))


def normal_cdf_sql(z: str) -> str:
    x = f"(abs({z}) / sqrt(2))"
    t, poly = f"(1 / (1 + {ERF_P} * {x}))", "0.0"
    for a in reversed(ERF_A):
        poly = f"({poly} + {a}) * {t}"
    return f"(0.5 * (1 + sign({z}) * (1 - {poly} * exp(-{x} * {x}))))"


def normal_quantile(p: Column) -> Column:
    """The value under which a share ``p`` of the normal distribution lies; ``p`` is kept 1e-12 off 0 and 1."""

    def poly(coefficients, x):
        out = F.lit(0.0)
        for c in coefficients:
            out = out * x + c
        return out

    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    q = p - 0.5
    t = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    tail = poly(TAIL_C, t) / poly(TAIL_D, t)
    return F.when(F.least(p, 1 - p) < TAIL, F.when(q < 0, tail).otherwise(-tail)).otherwise(poly(MIDDLE_A, q * q) * q / poly(MIDDLE_B, q * q))


def normal_quantile_sql(p: str) -> str:
    def poly(coefficients, x):
        out = "0.0::DOUBLE"
        for c in coefficients:
            out = f"({out} * {x} + {c!r}::DOUBLE)"
        return out

    p = f"least(greatest({p}, 1e-12), 1 - 1e-12)"
    q, t = f"({p} - 0.5)", f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    tail = f"({poly(TAIL_C, t)} / {poly(TAIL_D, t)})"
    return f"(CASE WHEN least({p}, 1 - {p}) < {TAIL} THEN CASE WHEN {q} < 0 THEN {tail} ELSE -{tail} END ELSE {poly(MIDDLE_A, f'({q} * {q})')} * {q} / {poly(MIDDLE_B, f'({q} * {q})')} END)"


def expected_max(n: int) -> float:
    """Expected largest of ``n`` standard normal draws, by its usual approximation."""
    if n <= 1:
        return 0.0
    inv = NormalDist().inv_cdf
    return (1 - EULER_GAMMA) * inv(1 - 1 / n) + EULER_GAMMA * inv(1 - 1 / (n * math.e))
