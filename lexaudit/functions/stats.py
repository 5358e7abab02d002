"""Exact binomial statistics as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 100


def log_factorial(n: Column) -> Column:
    """ln n! as a sum of logarithms; 0 for n below 2."""
    return F.aggregate(F.when(n >= 2, F.sequence(F.lit(2).cast("long"), n.cast("long"))).otherwise(F.array().cast("array<long>")), F.lit(0.0), lambda a, i: a + F.ln(i.cast("double")))


def _tail(k: Column, n: Column, log_p: Column, log_q: Column) -> Column:
    """Sum over i from 0 to k of C(n, i) p^i q^(n - i), each term from the one before."""
    first = F.struct((n * log_q).alias("l"), F.exp(n * log_q).alias("s"))

    def step(a: Column, i: Column) -> Column:
        term = a["l"] + F.ln((n - i + 1).cast("double")) - F.ln(i.cast("double")) + log_p - log_q
        return F.struct(term.alias("l"), (a["s"] + F.exp(term)).alias("s"))

    order = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.aggregate(order, first, step, lambda a: a["s"])


def binom_cdf(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) of a binomial."""
    inner = _tail(k, n, F.ln(p), F.ln(1 - p))
    return F.when(k < 0, 0.0).when(k >= n, 1.0).when(p <= 0, 1.0).when(p >= 1, 0.0).otherwise(F.least(F.lit(1.0), inner))


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact McNemar test of b against c discordant pairs; 1 without any."""
    n, k = (b + c).cast("long"), F.least(b, c).cast("long")
    half = F.lit(-0.6931471805599453)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * _tail(k, n, half, half)))


def _bisected(k: Column, n: Column, target: float) -> Column:
    """p at which the distribution function of k reaches the target; it falls with p."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        cdf = binom_cdf(k, n, mid)
        low = cdf > target
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: (s["lo"] + s["hi"]) / 2)


def clopper_pearson(k: Column, n: Column, alpha: float = 0.05) -> Column:
    """{lo, hi} of the exact interval for k of n; (0, 1) for n = 0."""
    lo = F.when((n == 0) | (k == 0), 0.0).otherwise(_bisected(k - 1, n, 1 - alpha / 2))
    hi = F.when((n == 0) | (k == n), 1.0).otherwise(_bisected(k, n, alpha / 2))
    return F.struct(lo.alias("lo"), hi.alias("hi"))
