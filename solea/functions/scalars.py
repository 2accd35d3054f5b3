"""Column functions shared by the operators. All of them stay on the JVM side."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num/den with 0.0 where the denominator is zero."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def ratio_or_null(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def seeded_hash(key: Column, seed: int) -> Column:
    """A 31-bit multiplicative mix of an integer key: the same in any engine with 64-bit integers."""
    first = (key.cast("bigint") % 2147483647 * 1103515245 + F.lit(12345 + 7919 * seed)) % 2147483648
    folded = F.floor(first / 65536).cast("bigint")
    return ((first % 65536) * 69069 * 32749 + folded * 40503 + F.lit(1 + seed)) % 2147483647


_FINEST = 1e9  # scores nearer to 0 or 1 than its inverse are not told apart by the logarithms


def score_slot(score: Column, slots: int = 4096) -> Column:
    """An order-keeping slot number for any real score; splits a hot group into at most 6*slots+2 pieces.

    Three growing curves are added: one over all numbers and one logarithm each around 0 and 1, where the scores of a sure
    classifier crowd: half of the scores in [0.99, 1] still lie over more than a hundred slots. The number depends on the score
    alone, so a task that is run again deals its rows alike. Nulls and what is not a number have the last slot.
    """
    s = score.cast("double")
    around = lambda x: F.signum(x) * F.log1p(F.abs(x) * _FINEST) / math.log1p(_FINEST)
    bound = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    curve = s / (1.0 + F.abs(s)) + bound(around(s)) + bound(around(s - 1.0))
    endless = F.when(F.abs(s) == math.inf, F.signum(s) * 3)  # where the first curve has no value
    return F.when(F.isnan(s) | s.isNull(), 3 * slots + 1).otherwise(F.floor(F.coalesce(endless, curve) * slots).cast("int"))


def erf_positive(x: Column) -> Column:
    """erf for x >= 0 from its all-positive series; absolute error near 1e-15, 1.0 beyond x = 6."""
    z = F.least(x, F.lit(6.0))
    start = F.struct(z.alias("term"), z.alias("total"))

    def step(acc: Column, n: Column) -> Column:
        term = acc["term"] * 2.0 * z * z / (2.0 * n + 1.0)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(140)), start, step)["total"]
    return F.least(F.lit(1.0), F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-z * z) * series)


def normal_two_sided(z: Column) -> Column:
    return 1.0 - erf_positive(F.abs(z) / math.sqrt(2.0))


def chi2_1_tail(stat: Column) -> Column:
    return 1.0 - erf_positive(F.sqrt(stat / 2.0))


def binomial_half_cdf(k: Column, n: Column) -> Column:
    """P(X <= k) for Binomial(n, 1/2), for the small n of an exact test."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * (n - i + 1) / i
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k.cast("bigint"))).otherwise(
        F.array().cast("array<bigint>")
    )
    return F.aggregate(steps, start, step)["total"] / F.pow(F.lit(2.0), n)
