"""Tail probabilities of test statistics as column expressions.

The regularised incomplete gamma function by its series below its mean and by Lentz's continued fraction above it; the
chi-square tail follows, and the two-sided normal tail is that of a chi-square of one degree of freedom.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300
_LIFT = 20


def ln_gamma(a: Column) -> Column:
    """The logarithm of the gamma function for ``a`` > 0: Stirling's series twenty steps above ``a``."""
    z = a + _LIFT
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    lifted = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series
    # the logarithm of a product of ten factors at a time stays far from the ends of a double
    for k in range(0, _LIFT, 10):
        product = a + k
        for j in range(k + 1, k + 10):
            product = product * (a + j)
        lifted = lifted - F.ln(product)
    return lifted


def gamma_tail(a: Column, x: Column) -> Column:
    """Q(a, x), the upper regularised incomplete gamma function; null for a null, 1 at x = 0."""
    steps = F.sequence(F.lit(1), F.ceil(100 + 12 * F.sqrt(a)).cast("int"))
    scale = F.exp(a * F.ln(x) - x - ln_gamma(a))
    first = 1 / a
    below = F.aggregate(
        steps, F.struct(first.alias("term"), first.alias("sum")),
        lambda s, n: F.struct((s["term"] * x / (a + n)).alias("term"), (s["sum"] + s["term"] * x / (a + n)).alias("sum")),
        lambda s: s["sum"])

    def safe(v: Column) -> Column:
        return F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)

    def step(s: Column, n: Column) -> Column:
        factor, b = n * (a - n), x + 1 - a + 2 * n
        d = 1 / safe(factor * s["d"] + b)
        c = safe(b + factor / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    start = 1 / safe(x + 1 - a)
    above = F.aggregate(steps, F.struct(F.lit(1 / _TINY).alias("c"), start.alias("d"), start.alias("h")), step, lambda s: s["h"])
    tail = F.when(x <= 0, F.lit(1.0)).when(x < a + 1, 1 - scale * below).otherwise(scale * above)
    return F.when(a.isNotNull() & x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))


def chi_square_tail(statistic: Column, dof: Column) -> Column:
    """P(X >= statistic) for a chi-square variable; 1 without degrees of freedom."""
    a = F.greatest(dof.cast("double"), F.lit(1.0)) / 2
    return F.when(dof < 1, F.lit(1.0)).when(dof.isNotNull(), gamma_tail(a, statistic / 2))


def normal_tail(z: Column) -> Column:
    """P(|Z| >= |z|) for a standard normal variable."""
    return gamma_tail(F.lit(0.5), z * z / 2)
