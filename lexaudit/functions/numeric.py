"""Numbers and arrays of numbers by rank or level, as native columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SCALES = (1.0, 100.0, 0.01)
GRID_STEPS = (5.0, 1.0, 0.5, 0.1, 0.05, 0.01)
LEVELS = 18


def clean(x: Column) -> Column:
    """Without the noise of single precision."""
    return F.round(x, 6)


def decimals(x: Column) -> Column:
    """Digits after the point in the shortest writing of a number."""
    s = F.regexp_extract(x.cast("string"), r"\.(\d+)$", 1)
    return F.when(x.isNull(), F.lit(None).cast("int")).otherwise(F.length(F.regexp_replace(s, "^0$", "")))


def precision(values: Column) -> Column:
    """The most decimals of any value."""
    return F.array_max(F.transform(values, decimals))


def near(a: Column, b: Column, eps: float = 1e-9) -> Column:
    return F.abs(a - b) <= eps


def close(a: Column, b: Column, eps: float = 1e-6) -> Column:
    """Equal within eps of the larger, or of 1."""
    return F.abs(a - b) <= eps * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def number_matches(typed: Column, places: Column, value: Column, slack: float = 0.02) -> Column:
    """Whether a typed number is the value at one of the scales, exactly or rounded to its places within slack."""
    out = F.lit(False)
    for s in SCALES:
        y = value * F.lit(s)
        p = F.pow(F.lit(10.0), places)
        out = out | (F.abs(y - typed) < 1e-9) | ((F.abs(F.round(y * p) / p - typed) < 1e-9) & (F.abs(y - typed) <= slack * F.abs(typed)))
    return out


def same_ranks(a: Column, b: Column) -> Column:
    """Whether two arrays agree rank by rank at one scale; a single value stands for all ranks; null if not comparable."""
    n = F.greatest(F.size(a), F.size(b))
    wide = lambda x: F.when(F.size(x) == 1, F.array_repeat(F.element_at(x, 1), n)).otherwise(x)
    x, y = wide(a), wide(b)
    ok = (F.size(x) == F.size(y)) & (F.size(x) > 0) & F.forall(F.concat(x, y), lambda v: v.isNotNull() & ~F.isnan(v))
    agree = F.lit(False)
    for s in SCALES:
        agree = agree | _agree(x, y, s)
    return F.when(ok, agree)


def _agree(x: Column, y: Column, scale: float) -> Column:
    pairs = F.zip_with(x, y, lambda p, q: F.abs(p * F.lit(scale) - q) <= F.lit(1e-6) * F.greatest(F.lit(1.0), F.abs(q)))
    return F.forall(pairs, lambda v: v)


def ranked(values: Column, rank: Column) -> Column:
    """The value at a rank (from 0); nulls are left out first, the last value stands for all later ranks."""
    own = F.filter(values, lambda v: v.isNotNull())
    return F.get(own, F.least(rank, F.size(own) - 1))


def by_rank(values: Column, ranks: Column) -> Column:
    """The values at the ranks, cleaned."""
    own = F.filter(values, lambda v: v.isNotNull())
    return F.transform(ranks, lambda r: clean(F.get(own, F.least(r, F.size(own) - 1))))


def scaled(values: Column, factor: Column) -> Column:
    """The values times a factor if that is exact at their own precision; else null."""
    p = F.pow(F.lit(10.0), precision(values))
    exact = F.forall(values, lambda v: F.abs(F.round(v * factor * p) - v * factor * p) < 1e-6)
    return F.when(exact, F.transform(values, lambda v: F.round(v * factor * p) / p))


def grid_step(values: Column, steps: Sequence[float] = GRID_STEPS) -> Column:
    """The largest of the steps of which every value is a multiple; null if none."""
    on = lambda g: F.forall(values, lambda v: F.abs(v / g - F.round(v / g)) < 1e-6)
    return F.get(F.filter(F.array(*map(F.lit, steps)), on), F.lit(0))


def progression(level: Column) -> Column:
    """How far a stat has grown at a level."""
    past = F.greatest(level, F.lit(1)) - 1
    return past * (F.lit(0.7025) + F.lit(0.0175) * past)


def interpolated(start: Column, end: Column, by_progression: Column, levels: int = LEVELS) -> Column:
    """Values at all levels between two ends, evenly or as stats grow."""

    def at(lv: Column) -> Column:
        reached = F.when(by_progression, progression(lv)).otherwise(lv - 1)
        share = reached / (levels - 1)
        return start * (1 - share) + end * share

    return F.transform(F.sequence(F.lit(1), F.lit(levels)), at)


def stepped(level1: Column, initial: Column, points: Column, levels: int = LEVELS) -> Column:
    """Values at all levels from points {level, bonus, per_level} in order; a point beyond the level ends the walk."""

    def at(lv: Column) -> Column:
        start = F.struct(level1.cast("double").alias("v"), F.lit(1).alias("reached"), initial.cast("double").alias("rate"), F.lit(False).alias("over"))

        def step(s: Column, p: Column) -> Column:
            over = s["over"] | (p["level"] > lv)
            on = F.struct((s["v"] + (p["level"] - 1 - s["reached"]) * s["rate"] + p["bonus"]).alias("v"), (p["level"] - 1).cast("int").alias("reached"), p["per_level"].cast("double").alias("rate"), F.lit(False).alias("over"))
            off = F.struct(s["v"].alias("v"), s["reached"].alias("reached"), s["rate"].alias("rate"), F.lit(True).alias("over"))
            return F.when(over, off).otherwise(on)

        return F.aggregate(points, start, step, lambda s: s["v"] + F.when(lv > s["reached"], (lv - s["reached"]) * s["rate"]).otherwise(F.lit(0.0)))

    return F.transform(F.sequence(F.lit(1), F.lit(levels)), at)


def shares(n: Column, k: Column) -> Column:
    """n as k whole numbers that differ by one at most, larger ones first."""
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: (F.floor(n / k) + F.when(i < n % k, 1).otherwise(0)).cast("long"))
