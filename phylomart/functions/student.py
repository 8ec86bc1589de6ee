"""Student's t distribution as a column expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 20  # below this, the gamma ratio is carried up before it is expanded


def _gamma_step(a: Column) -> Column:
    """ln of gamma(a + 1/2) / gamma(a), a > 0: the expansion in 1/a at a + SHIFT, brought back by the factors in between."""
    high = a + SHIFT
    series = F.log(high) / 2 - 1 / (8 * high) + 1 / (192 * F.pow(high, F.lit(3))) - 1 / (640 * F.pow(high, F.lit(5))) + 17 / (14336 * F.pow(high, F.lit(7)))
    return F.aggregate(F.sequence(F.lit(0), F.lit(SHIFT - 1)), series, lambda s, k: s + F.log((a + k) / (a + k + 0.5)))


def _away(x: Column) -> Column:
    """``x``, kept off zero."""
    return F.when(F.abs(x) < 1e-300, F.lit(1e-300)).otherwise(x)


def _fraction(a: Column, b: Column, x: Column, steps: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its front in ratios of neighbouring terms."""
    first = 1 / _away(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def term(s: Column, k: Column) -> Column:
        d, c = 1 / _away(1 + k * s["d"]), _away(1 + k / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    def pair(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        # held as lambda variables, so that no step is written out twice
        half = F.transform(F.array(term(s, even)), lambda t: term(t, odd))
        return half[0]

    return F.aggregate(F.sequence(F.lit(1), steps), start, pair, lambda s: s["h"])


def two_sided_p(t: Column, df: Column) -> Column:
    """Chance of a value of Student's t at least as far from 0 as ``t``; null for a null t, or without degrees of freedom.

    It is the regularised incomplete beta function of df / (df + t^2) at (df/2, 1/2), computed by whichever of its two continued fractions
    converges; the steps grow with the root of df. Exact to about 1e-12.
    """
    n = F.when(df > 0, df.cast("double"))
    a, b, square = n / 2, F.lit(0.5), t * t / n
    x, rest = 1 / (1 + square), square / (1 + square)
    # x**a * rest**b / B(a, b); ln B(a, 1/2) is ln(pi)/2 less the gamma step
    front = F.exp(-a * F.log1p(square) + F.log(rest) / 2 - math.log(math.pi) / 2 + _gamma_step(a))
    steps = (F.lit(60) + 4 * F.sqrt(n)).cast("int")
    near = 1 - front * _fraction(b, a, rest, steps) / b
    far = front * _fraction(a, b, x, steps) / a
    return F.when(t == 0, F.when(n.isNotNull(), 1.0)).when(F.abs(t) == float("inf"), F.when(n.isNotNull(), 0.0)).when(x < (a + 1) / (a + b + 2), far).otherwise(near)
