"""Append-only logs and caches as streams: what is new is taken up, what is known is left alone.

A folder of lines is read with Trigger.AvailableNow: each start takes the files that no earlier start has
seen, which the checkpoint remembers, and ends.  Batches are idempotent: what they append is anti-joined
with what is there, so a batch that is repeated after a failure adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexaudit.operators.windows import last_per_key
from lexaudit.sources.files import exists


def lines_stream(spark: SparkSession, path: str, schema: StructType | str, *, files_at_once: int = 1000) -> DataFrame:
    """New JSON lines of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(path)


def fill_keyed_cache(jobs: DataFrame, cache_path: str, checkpoint: str, judge: Callable[[DataFrame], DataFrame], key: str = "key") -> None:
    """Judges each new key of a stream of jobs once and appends the result to the cache table.

    judge maps rows of jobs to rows of the cache.  Keys that the cache holds, and repeats within a batch,
    are not judged.  Runs until nothing is left to read.
    """

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        todo = df.where(F.col(key).isNotNull()).dropDuplicates([key])
        if exists(spark, cache_path):
            todo = todo.join(spark.read.parquet(cache_path).select(key), key, "left_anti")
        judge(todo).write.mode("append").parquet(cache_path)

    q = jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def append_once(lines: DataFrame, log_path: str, checkpoint: str) -> None:
    """Copies new lines of a stream to a log as they are."""
    q = lines.writeStream.format("parquet").option("path", log_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def current(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last line of each key."""
    return last_per_key(log, [key], order)


def keyed_cache_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as an append log: each (user, type) is judged once, over two starts of the stream; returns the cache."""
    import uuid

    from lexaudit.sources.shared import shared_dir

    at = f"{shared_dir(spark)}/lexaudit/stream-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.concat_ws(":", "user_id", "event_type").alias("key"), "event_id", F.col("value").alias("v"), "user_id")
    early, late = rows.where("user_id < 75"), rows
    for part in (early, late):
        part.drop("user_id").write.mode("append").json(f"{at}/log")
        stream = lines_stream(spark, f"{at}/log", "key string, event_id long, v double")
        fill_keyed_cache(stream, f"{at}/cache", f"{at}/checkpoint", lambda d: d.select("key", F.length("key").cast("long").alias("verdict")))
    return spark.read.parquet(f"{at}/cache")


QUERIES = {"keyed_cache_fill": keyed_cache_fill}
SQL = {"keyed_cache_fill": "SELECT key, length(key)::BIGINT AS verdict FROM (SELECT DISTINCT user_id || ':' || event_type AS key FROM events)"}
