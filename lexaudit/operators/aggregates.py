"""Votes, recall and precision, contingency, cost, coverage, gaps and size statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexaudit.functions.stats import clopper_pearson, mcnemar_exact
from lexaudit.sources.shared import written


def any_match(rows: DataFrame, keys: Sequence[str], hit: Column, name: str = "caught") -> DataFrame:
    """Whether any row of each group is a hit; null hits count as none."""
    return rows.groupBy(*keys).agg(F.coalesce(F.bool_or(F.coalesce(hit, F.lit(False))), F.lit(False)).alias(name))


def majority(runs: DataFrame, keys: Sequence[str], vote: str, name: str = "caught") -> DataFrame:
    """Strict majority of the runs of each group."""
    yes = F.sum(F.when(F.col(vote), 1).otherwise(0))
    return runs.groupBy(*keys).agg(yes.alias("votes"), F.count(F.lit(1)).alias("runs"), (2 * yes > F.count(F.lit(1))).alias(name))


def contingency(cases: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row: both, only_a, only_b, neither and the exact McNemar p of the discordant pairs."""
    n = lambda x: F.count_if(x)
    t = cases.agg(n(a & b).alias("both"), n(a & ~b).alias("only_a"), n(~a & b).alias("only_b"), n(~a & ~b).alias("neither"))
    return t.withColumn("p", mcnemar_exact(F.col("only_a"), F.col("only_b")))


def recall(cases: DataFrame, groups: Sequence[str], caught: Column, *, interval: bool = False) -> DataFrame:
    """k, n and share of caught cases for all levels of a rollup over groups (null: all of it)."""
    out = cases.rollup(*groups).agg(F.count_if(caught).alias("k"), F.count(F.lit(1)).alias("n"))
    out = out.withColumn("share", F.round(F.col("k") / F.col("n"), 6))
    if interval:
        out = out.withColumn("ci", clopper_pearson(F.col("k"), F.col("n")))
    return out


def precision(labels: DataFrame, groups: Sequence[str], label: str, records: Column, *, right: str, unsure: str) -> DataFrame:
    """real, cant_tell, judged, precision, precision_sure and flags per 1000 records of each group; null where undefined."""
    real, doubt, n = F.count_if(F.col(label) == right), F.count_if(F.col(label) == unsure), F.count(F.lit(1))
    return labels.groupBy(*groups).agg(
        real.alias("real"),
        doubt.alias("cant_tell"),
        n.alias("judged"),
        F.round(F.try_divide(real, n), 6).alias("precision"),
        F.round(F.try_divide(real, n - doubt), 6).alias("precision_sure"),
        F.round(F.try_divide(1000 * n, F.max(records)), 6).alias("per_1000"),
    )


def cost(lines: DataFrame, prices: DataFrame, groups: Sequence[str], on: str, *, prompt: str, cached: str, completion: str) -> DataFrame:
    """Summed cost at prices(input, cache_read, output per million) and lines without counts, which are left out."""
    missing = F.col(prompt).isNull() | F.col(completion).isNull()
    c = F.coalesce(F.col(cached), F.lit(0))
    paid = ((F.col(prompt) - c) * F.col("input") + c * F.col("cache_read") + F.col(completion) * F.col("output")) / 1e6
    return lines.join(prices, on).groupBy(*groups).agg(F.round(F.coalesce(F.sum(F.when(~missing, paid)), F.lit(0.0)), 6).alias("cost"), F.count_if(missing).alias("missing"), F.count(F.lit(1)).alias("lines"))


def coverage(rows: DataFrame, by: str, conditions: Mapping[str, Column]) -> DataFrame:
    """Counts of each condition, in all (by is null) and by group, with shares of the rows to four places."""
    counts = [F.count_if(c).alias(k) for k, c in conditions.items()]
    g = rows.groupingSets([[], [F.col(by)]], F.col(by)).agg(F.grouping(by).cast("int").alias("is_total"), F.count(F.lit(1)).alias("n"), *counts)
    return g.select(by, "is_total", "n", *conditions, *(F.round(F.col(k) / F.col("n"), 4).alias(f"{k}_share") for k in conditions))


def exploded_counts(rows: DataFrame, values: Column, groups: Sequence[str] = (), name: str = "part") -> DataFrame:
    """How often each element of the arrays occurs."""
    return rows.select(*groups, F.explode(values).alias(name)).groupBy(*groups, name).agg(F.count(F.lit(1)).alias("n"))


def gaps(numbers: DataFrame, column: str) -> DataFrame:
    """Whole numbers between 0 and the largest that do not occur, as (first, last) runs.

    Neighbours are found on sorted ranges by a lead within the range partition and one across their ends,
    so the numbers are never gathered into one array.
    """
    spark = numbers.sparkSession
    own = numbers.select(F.col(column).cast("long").alias("x")).where("x >= 0").distinct()
    most = own.agg(F.max("x")).first()[0]
    if most is None:
        return spark.createDataFrame([], "first long, last long")
    # x is followed by a gap if x + 1 is missing; it ends one if x - 1 is: two anti-joins
    after = own.select((F.col("x") + 1).alias("x")).unionByName(spark.range(1).select(F.lit(0).cast("long").alias("x"))).join(own, "x", "left_anti").where(F.col("x") <= most)
    before = own.select((F.col("x") - 1).alias("x")).where("x >= 0").join(own, "x", "left_anti")
    # starts and ends alternate: the k-th start belongs to the k-th end
    from lexaudit.operators.windows import numbered

    s = numbered(after.withColumnRenamed("x", "first"), [F.col("first")], "k")
    e = numbered(before.withColumnRenamed("x", "last"), [F.col("last")], "k")
    return s.join(e, "k").select("first", "last")


def sizes(rows: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    """count, sum, median (mean of the middle two) and max of a column; a group without values has no median."""
    most = rows.groupBy(*groups).agg(F.count(column).alias("n"), F.sum(column).alias("total"), F.max(column).alias("most"))
    middle = medians(rows, column, groups).select(*(F.col(g).alias(f"_{i}") for i, g in enumerate(groups)), "median")
    on = [F.col(g).eqNullSafe(F.col(f"_{i}")) for i, g in enumerate(groups)] or F.lit(True)
    return most.join(middle, on, "left").select(*groups, "n", "total", "median", "most")


#: Ranges that a round of medians counts for each group, and up to how many groups' ranges are broadcast.
RANGES, MOST_BROADCAST = 1024, 100_000


def medians(rows: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, median): the mean of the middle two values of each group, exactly, found by counting.

    Equal values are counted once.  Then each round counts the values of each group in ranges between the bounds
    of its middle and goes on within the range that holds it, until one value is left; no task holds a group's values.
    Nulls and NaN do not count; a group without values is left out.
    """
    g = [f"_g{i}" for i in range(len(groups))]
    x = rows.select(*(F.col(a).alias(b) for a, b in zip(groups, g, strict=True)), F.col(column).alias("_x"))
    x = x.where(~F.isnan(F.col("_x").cast("double")) & F.col("_x").isNotNull())
    counts = written(x.groupBy(*g, "_x").agg(F.count(F.lit(1)).alias("_n")), "counts")
    ends = counts.groupBy(*g).agg(F.sum("_n").alias("_all"), F.min("_x").alias("lo"), F.max("_x").alias("hi")).where("_all > 0")
    ranks = F.array_distinct(F.array(F.expr("(_all - 1) div 2"), F.expr("_all div 2")))
    todo = written(ends.select(*g, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below")), "middles")
    while not todo.where("lo < hi").isEmpty():
        spans = todo.where("lo < hi").select(*g, "lo", "hi", "below").distinct()
        own = F.broadcast(spans) if spans.count() <= MOST_BROADCAST else spans
        named = own.select(*(F.col(c).alias(f"{c}_") for c in g), "lo", "hi", "below")
        same = lambda: [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in g]
        inside = counts.join(named, [*same(), F.col("_x") >= F.col("lo"), F.col("_x") <= F.col("hi")])
        half = lambda c: F.col(c).cast("double") / 2  # noqa: E731  two values may be further apart than a double can say
        place = F.least(F.lit(RANGES - 1), F.floor((half("_x") - half("lo")) / (half("hi") - half("lo")) * RANGES))
        place = F.when(F.col("_x") == F.col("lo"), 0).when(F.col("_x") == F.col("hi"), RANGES - 1).otherwise(F.coalesce(place, F.lit(0)))
        h = inside.groupBy(*g, "lo", "hi", "below", place.alias("_p")).agg(F.sum("_n").alias("_n"), F.min("_x").alias("low"), F.max("_x").alias("high"))
        upto = Window.partitionBy(*g, "lo", "hi").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        h = h.withColumn("first", F.col("below") + F.coalesce(F.sum("_n").over(upto), F.lit(0)))
        h = h.select(*(F.col(c).alias(f"{c}_") for c in g), F.col("lo").alias("lo_"), F.col("hi").alias("hi_"), "low", "high", "first", "_n")
        hit = [*same(), F.col("lo") == F.col("lo_"), F.col("hi") == F.col("hi_"), F.col("rank") >= F.col("first"), F.col("rank") < F.col("first") + F.col("_n")]
        going = todo.where("lo < hi").join(h, hit).select(*g, "rank", F.col("low").alias("lo"), F.col("high").alias("hi"), F.col("first").alias("below"))
        todo = written(todo.where("lo = hi").unionByName(going), "middles")
    return todo.groupBy(*g).agg(F.avg(F.col("lo").cast("double")).alias("median")).select(*(F.col(b).alias(a) for a, b in zip(groups, g, strict=True)), "median")


def intersection(votes: DataFrame, keys: Sequence[str], allowed: str) -> DataFrame:
    """What all array-valued votes of a group allow, sorted; decided if one thing is left.

    Votes are exploded and counted, so that no group's votes are gathered.
    """
    total = votes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    each = votes.select(*keys, F.explode(F.array_distinct(allowed)).alias("_v")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    common = total.join(each, list(keys)).where("_c = _n").groupBy(*keys).agg(F.array_sort(F.collect_list("_v")).alias("common"))
    out = total.join(common, list(keys), "left").withColumn("common", F.coalesce("common", F.array().cast(common.schema["common"].dataType)))
    return out.select(*keys, "common", (F.size("common") == 1).alias("decided"))


def merged_flags(flags: DataFrame, keys: Sequence[str], rules: Sequence[str]) -> DataFrame:
    """One flag for each key: its rules joined by + in the order of ``rules``, its details by ``; ``, the first names."""
    rank = F.array_position(F.array(*map(F.lit, rules)), F.col("rule")).cast("int")
    all_ = F.array_sort(F.collect_set(F.struct(rank.alias("o"), F.col("pos").alias("p"), F.col("rule").alias("r"), F.col("names").alias("n"), F.col("detail").alias("d"))))
    g = flags.groupBy(*keys).agg(all_.alias("_a"))
    return g.select(*keys, F.array_join(F.array_distinct(F.transform("_a", lambda x: x["r"])), "+").alias("rule"), F.element_at("_a", 1)["n"].alias("names"), F.array_join(F.array_distinct(F.transform("_a", lambda x: x["d"])), "; ").alias("detail"))
