"""Top-1 per key, ordering, numbering and carry-down.

Top-1 is an aggregation of structs, not a window: it combines before the shuffle and needs no sort, so
a key with very many rows costs one row a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _top(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*(F.col(c) for c in [*order, *rest]))
    g = df.groupBy(*keys).agg((F.max(row) if pick == "last" else F.min(row)).alias("_row"))
    return g.select(*(F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns))


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that comes last by order; remaining columns, which must be orderable, break ties."""
    return _top(df, keys, order, "last")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that comes first by order."""
    return _top(df, keys, order, "first")


def most_common(df: DataFrame, value: str, position: str) -> DataFrame:
    """(value, n, first_position), most frequent first, ties by first appearance."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first_position")).orderBy(F.desc("n"), "first_position")


def version_key(version: Column) -> Column:
    """{major, minor, letter} of ``major.minor[letter]``: sorts as versions do; null if it is none."""
    pattern = r"^(\d+)\.(\d+)([A-Za-z]?)$"
    part = lambda i: F.regexp_extract(version, pattern, i)
    return F.when(version.rlike(pattern), F.struct(part(1).cast("int").alias("major"), part(2).cast("int").alias("minor"), F.lower(part(3)).alias("letter")))


def carry_down(df: DataFrame, column: str, partition: Sequence[str], order: Sequence[str | Column], partitions: int | None = None) -> DataFrame:
    """column with nulls replaced by the last value before them in their partition (a null key is a key too).

    Rows are cut into ranges of partition and order, so that a hot key spreads over many tasks; within a range
    a window carries values down, and what a key brings from its earlier ranges is joined in.  A boundary of
    ranges lies within one key at most, so there are no more such rows than ranges, and they are broadcast.
    """
    from lexaudit.sources.shared import written

    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(n, *partition, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(*partition, "_range").orderBy(*order)
    done = placed.withColumn("_place", F.row_number().over(own)).withColumn(column, F.last(column, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # the last row of each key's range; only keys of several ranges go on
    ends = done.groupBy(*partition, "_range").agg(F.max_by(column, "_place").alias("_brought"))
    earlier = Window.partitionBy(*partition).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    brought = ends.withColumn("_brought", F.last("_brought", ignorenulls=True).over(earlier)).where("_brought IS NOT NULL")
    brought = brought.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(partition)), F.col("_range").alias("_r"), "_brought")
    on = [F.col("_range") == F.col("_r"), *(F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(partition))]
    return done.join(F.broadcast(brought), on, "left").withColumn(column, F.coalesce(column, "_brought")).select(*df.columns)


def numbered(df: DataFrame, order: Sequence[Column], name: str = "number", partitions: int | None = None) -> DataFrame:
    """df with its rank (from 1) in a total order, without bringing all rows to one task.

    Rows are range-partitioned, counted by partition, and numbered within; what the driver sees is one
    count a partition.
    """
    from lexaudit.sources.shared import written

    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.select("*", *(c.alias(f"_o{i}") for i, c in enumerate(order)))
    keys = [f"_o{i}" for i in range(len(order))]
    placed = written(keyed.repartitionByRange(n, *keys).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = {r["_p"]: r["count"] for r in placed.groupBy("_p").count().collect()}
    before, total = {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    base = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("_p")) if before else F.lit(0)
    w = Window.partitionBy("_p").orderBy(*keys)
    return placed.withColumn(name, (base + F.row_number().over(w)).cast("long")).drop("_p", *keys)
