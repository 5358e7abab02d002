"""What several operators of this subpackage share: the shared folder, tables written there, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.sources.shared import written

__all__ = ["free_name", "hash_sample", "restored", "set_aside", "small_batches", "table", "written"]

#: Rows and bytes of one Arrow batch.  Texts may be very long, so batches are also bounded by bytes.
BATCH_ROWS = 1000
BATCH_BYTES = 16 * 1024 * 1024


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches, so that a Python worker never holds more than a few MB of texts beside one very long one."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, want: str) -> str:
    """A column name close to want that df does not have (names compare without case)."""
    have = {c.lower() for c in df.columns}
    while want.lower() in have:
        want = f"_{want}"
    return want


def hash_sample(df: DataFrame, n: int, *key: str) -> DataFrame:
    """n rows of df (all if fewer), the first in the order of a hash of their key: the same on every run.

    Rows whose hash is too large to be among them are left out first, so that every task sends few rows
    however many tasks there are.
    """
    total = df.count()
    h = F.xxhash64(*key)
    share = 4.0 * n / max(total, 1)
    if share < 1.0:
        df = df.where(h < F.lit(int(-(2**63) + share * 2**64)).cast("long"))
    return df.orderBy(h, *key).limit(n)


def set_aside(df: DataFrame, *but: str) -> tuple[DataFrame, list[str], list[str]]:
    """df with all columns but some renamed to names that an operator cannot clash with; (df, own names, new names).

    The columns of ``but`` (compared without case) keep their place but not in the lists.
    """
    skip = {c.lower() for c in but}
    keep = [c for c in df.columns if c.lower() not in skip]
    new = [f"__kept{i}" for i in range(len(keep))]
    return df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, new, strict=True)), *(F.col(f"`{c}`") for c in df.columns if c.lower() in skip)), keep, new


def restored(keep: list[str], new: list[str]) -> list:
    """Columns that set_aside renamed, under their own names."""
    return [F.col(n).alias(c) for c, n in zip(keep, new, strict=True)]
