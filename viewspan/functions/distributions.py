"""Tail probabilities as column expressions, from series of positive terms, so that tests with many rows stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of a series; enough for normal deviates up to ``FAR`` and chi-squares up to its square.
TERMS, FAR = 240, 9.0


def _series(first: Column, factor, terms: int = TERMS) -> Column:
    """Sum of a first term and the following ones, each the one before times ``factor(k)``."""
    start = F.struct(first.alias("t"), first.alias("s"))

    def step(acc, k):
        t = acc["t"] * factor(k)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda a: a["s"])


def normal_p2(z: Column) -> Column:
    """Two-sided p of a normal deviate; null stays null."""
    a = F.abs(z).cast("double")
    inner = _series(a, lambda k: a * a / (2 * k + 1)) * F.exp(-a * a / 2) * math.sqrt(2 / math.pi)
    return F.when(a > FAR, F.lit(0.0)).when(a.isNotNull(), F.greatest(F.lit(0.0), 1 - inner))


def chi2_sf(x: Column, df: Column) -> Column:
    """Upper tail of the chi-square distribution with a whole number of degrees of freedom; 1 at ``x <= 0``."""
    x, a = x.cast("double"), df.cast("double") / 2
    half = F.floor(a)
    odd = a > half
    # log gamma(a + 1) of a whole or half number, as a sum of logarithms
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), half.cast("int")))
    log_gamma = F.when(odd, F.lit(math.log(math.sqrt(math.pi) / 2))).otherwise(F.lit(0.0)) + F.when(half > 0, F.aggregate(steps, F.lit(0.0), lambda acc, k: acc + F.log(k + F.when(odd, 0.5).otherwise(0.0)))).otherwise(F.lit(0.0))
    first = F.exp(a * F.log(x / 2) - x / 2 - log_gamma)
    lower = _series(first, lambda k: (x / 2) / (a + k))
    return F.when(x <= 0, F.lit(1.0)).when(x > 2 * FAR * FAR + 4 * df, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - lower))


def t_p2(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t with a whole number of degrees of freedom, by the finite sums of the distribution."""
    t, df = F.abs(t).cast("double"), df.cast("int")
    root = F.sqrt(df.cast("double"))
    theta, cos2 = F.atan(t / root), df / (df + t * t)
    sin, cos = t / F.sqrt(df + t * t), F.sqrt(cos2)
    odd = df % 2 == 1
    # odd: cos, then times (2k / (2k + 1)) cos^2; even: 1, then times ((2k - 1) / (2k)) cos^2
    n = F.when(odd, (df - 3) / 2).otherwise((df - 2) / 2).cast("int")
    first = F.when(odd, cos).otherwise(F.lit(1.0))
    start = F.struct(first.alias("t"), first.alias("s"))

    def step(acc, k):
        x = acc["t"] * cos2 * F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        return F.struct(x.alias("t"), (acc["s"] + x).alias("s"))

    total = F.when(n >= 1, F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), start, step, lambda a: a["s"])).otherwise(first)
    area = F.when(df == 1, 2 * theta / math.pi).when(odd, (theta + sin * total) * 2 / math.pi).otherwise(sin * total)
    return F.when(t.isNotNull() & (df >= 1), F.greatest(F.lit(0.0), 1 - area))
