"""Set operations over keys and arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaudit.sources.shared import settings, written


def union_all(*parts: DataFrame) -> DataFrame:
    """All rows of all parts by name; missing columns are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def key_counts(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many distinct keys are only in a, only in b and in both, by one aggregation of their union."""
    both = a.select(*keys, F.lit(1).alias("_s")).unionByName(b.select(*keys, F.lit(2).alias("_s")))
    side = both.groupBy(*keys).agg(F.bit_or("_s").alias("_s"))
    return side.agg(*(F.count_if(F.col("_s") == v).alias(n) for v, n in ((1, "only_a"), (2, "only_b"), (3, "both"))))


def missing(wanted: DataFrame, available: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys that are wanted but not available."""
    return wanted.select(*keys).distinct().join(available.select(*keys), list(keys), "left_anti")


#: Rows that one task of a shuffle gets at most, about, where their number is known before.
TASK_ROWS = 1_000_000


def changed_paths(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, change) of rows that only one side has, repeats counted: removed from a, or added in b.

    One aggregation tells both: how often more a key is in a than in b.  Repeats combine before the shuffle,
    and the number of its tasks grows with the rows.
    """
    spark = a.sparkSession
    both = a.select(*keys, F.lit(1).alias("_n")).unionByName(b.select(*keys, F.lit(-1).alias("_n")))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-both.count() // TASK_ROWS))
    with settings(spark, {"spark.sql.shuffle.partitions": str(tasks)}):
        net = written(both.groupBy(*keys).agg(F.sum("_n").alias("_n")).where("_n <> 0"), "net")
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_n"))).alias("_i")
    return net.select(*keys, F.when(F.col("_n") > 0, "removed").otherwise("added").alias("change"), each).drop("_i")


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same elements, whatever their order and repeats."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
