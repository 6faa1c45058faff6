"""Student-t tail probabilities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Lanczos approximation of the gamma function (g = 7).
LANCZOS_G = 7.0
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
#: Steps of the continued fraction: those that small parameters need, and more as the root of large ones.
LEAST_STEPS, STEPS_PER_ROOT = 100, 3


def ln_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive number."""
    series: Column = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (x - 1.0 + i)
    t = x - 0.5 + LANCZOS_G
    return F.lit(0.5 * math.log(2 * math.pi)) + (x - 0.5) * F.log(t) - t + F.log(series)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function by Lentz's method."""
    away = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)
    steps = F.sequence(F.lit(1), (2 * (LEAST_STEPS + STEPS_PER_ROOT * F.ceil(F.sqrt(F.greatest(a, b))))).cast("int"))

    def term(k: Column) -> Column:
        m = F.ceil(k / 2).cast("double")
        odd = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        even = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(k % 2 == 1, odd).otherwise(even)

    first = 1.0 / away(1.0 - (a + b) * x / (a + 1.0))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def step(s: Column, num: Column) -> Column:
        d, c = 1.0 / away(1.0 + num * s["d"]), away(1.0 + num / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    return F.aggregate(F.transform(steps, term), start, step, lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column, rest: Column) -> Column:
    """Regularised incomplete beta function at ``x``; ``rest`` is 1 - x, given apart for its accuracy."""
    direct = x < (a + 1.0) / (a + b + 2.0)
    pick = lambda u, v: F.when(direct, u).otherwise(v)
    front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * F.log(x) + b * F.log(rest))
    tail = front * _fraction(pick(a, b), pick(b, a), pick(x, rest)) / pick(a, b)
    return F.when(x <= 0, 0.0).when(rest <= 0, 1.0).otherwise(F.when(direct, tail).otherwise(1.0 - tail))


def student_t_two_sided(t: Column, df: Column) -> Column:
    """Probability of a larger absolute t; null without a finite t or degrees of freedom."""
    square = t * t
    p = incomplete_beta(df / 2.0, F.lit(0.5), df / (df + square), square / (df + square))
    return F.when(t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf")) & (df > 0), p)
