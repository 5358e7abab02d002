"""Calls that may fail, tried again later, with the state of each record kept between starts.

A stream of records is keyed by id.  Each record's state holds how often it was tried, what that used and what
is to be tried; a failed attempt puts a timer to a time that doubles with each.  A start takes new
records, tries those that are due, and ends; the next start goes on at the attempt where each record was, on
whatever machine.  Time is what the starts say it is: each lands a tick, and the watermark follows it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexaudit.sources.shared import settings

#: (answer or None if it failed, what it used or None if unknown) of a record's text at an attempt, from 1.
Call = Callable[[str, int], tuple[str | None, int | None]]

MOST_ATTEMPTS = 3
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "true",
}
LANDED = "id string, text string, at timestamp"
OUT = "id string, attempts int, used long, answer string, failed boolean"


class Attempts(StatefulProcessor):
    """One record: tried when it comes, and again at its timer until it succeeds or has been tried ``most`` times."""

    def __init__(self, call: Call, most: int, pause_ms: int) -> None:
        self.call, self.most, self.pause_ms = call, most, pause_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempts", "tried int, used bigint, text string, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = min(((r.at_ms, r.text) for r in rows), key=lambda x: (x[0], x[1] or ""))
        if self.state.exists():  # a record that comes again is known
            return
        yield from self._try(key[0], 0, None, first[1], first[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        tried, used, text, done = self.state.get()
        if not done:
            yield from self._try(key[0], tried, used, text, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _try(self, id_: str, tried: int, used: int | None, text: str, now: int) -> Iterator[Row]:
        answer, more = self.call(text, tried + 1)
        tried += 1
        used = used if more is None else more + (used or 0)  # unknown until one attempt says what it used
        done = answer is not None or tried >= self.most
        self.state.update((tried, used, text, done))
        if done:
            yield Row(id=id_, attempts=tried, used=used, answer=answer, failed=answer is None)
        else:
            # timers fire once the watermark is beyond them
            self.handle.registerTimer(now + self.pause_ms * 2 ** (tried - 1) - 1)


def start(spark: SparkSession, root: str, records: DataFrame | None, now: datetime, call: Call, *, most: int = MOST_ATTEMPTS, pause_ms: int = 60_000) -> None:
    """Takes records(id, text), if any, and tries all that are due at ``now`` (times do not go back); what is settled is added to root/out."""
    tick = spark.createDataFrame([(None, None, now)], LANDED)
    new = tick if records is None else records.select(F.col("id").cast("string"), "text", F.lit(now).cast("timestamp").alias("at")).where("id IS NOT NULL").unionByName(tick)
    new.write.mode("append").parquet(f"{root}/in")
    rows = spark.readStream.schema(LANDED).parquet(f"{root}/in").withWatermark("at", "0 seconds").where("id IS NOT NULL OR at IS NULL")
    # no row lacks its time, but a condition on id alone would be taken below the watermark, which ticks have to pass
    rows = rows.select("id", "text", F.unix_millis("at").alias("at_ms"))
    done = rows.groupBy("id").transformWithState(Attempts(call, most, pause_ms), OUT, "Append", "EventTime")

    def keep(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")

    with settings(spark, STATE_SETTINGS):
        q = done.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()


def settled(spark: SparkSession, root: str) -> DataFrame:
    """(id, attempts, used, answer, failed, epoch) of all records that were answered or given up."""
    return spark.read.schema(f"{OUT}, epoch int").parquet(f"{root}/out")


def flaky(text: str, attempt: int) -> tuple[str | None, int | None]:
    """A call for tests: text is JSON with how many attempts fail and what an attempt uses, null if that is not said."""
    x = json.loads(text)
    return (f"answer {attempt}" if attempt > x["fails"] else None), (None if x["uses"] is None else x["uses"] + attempt)


def resumed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as calls that fail up to four times: three starts, the third with the records of all before again."""
    from lexaudit.sources.shared import scratch

    root = scratch(spark, "attempts")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    uses = F.when(F.col("c_custkey") % 7 > 0, F.col("c_custkey") % 10)
    text = F.to_json(F.struct((F.col("c_custkey") % 5).alias("fails"), uses.alias("uses")), {"ignoreNullFields": "false"})
    records = c.select(F.col("c_custkey").alias("id"), text.alias("text"))
    minute = lambda m: datetime(2024, 1, 1, 0, m, tzinfo=timezone.utc)  # noqa: E731, UP017
    start(spark, root, records, minute(0), flaky)
    start(spark, root, None, minute(1), flaky)
    start(spark, root, records, minute(3), flaky)
    return settled(spark, root).select("id", "attempts", "used", "answer", "failed")


QUERIES = {"resumed_attempts": resumed_attempts}
SQL = {
    "resumed_attempts": """SELECT c_custkey::VARCHAR AS id, n::INT AS attempts, CASE WHEN c_custkey % 7 > 0 THEN n * (c_custkey % 10) + n * (n + 1) // 2 END::BIGINT AS used,
  CASE WHEN c_custkey % 5 < 3 THEN 'answer ' || n END AS answer, c_custkey % 5 >= 3 AS failed FROM (SELECT c_custkey, least(3, c_custkey % 5 + 1) AS n FROM customer)"""
}
