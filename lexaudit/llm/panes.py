"""Hourly panes of clicks that are written when they are due and revised until they close (op13).

A table of clicks is cut into batches, each batch is landed in a folder that a Structured Streaming query
watches, and the query is started anew for each on one checkpoint.  State is kept for each kind and day
(transformWithState, row by row): a map from hour to totals, the set of hours that were written and got new
rows, and one timer, put anew to the earliest time at which a pane of the shard is due or closes.

What decides between tasks is small: rows are summed by kind and hour in the task that reads them, so a shard
gets a row an hour and reading task whatever its kind's share of all rows is.  Rows of closed panes are kept
one by one; they go through lanes dealt by click, which hold no state.  The driver gets the largest event time
of each batch, twelve numbers.

Time.  The watermark is the largest event time of earlier batches, without delay.  Event times may lie before
1970, where a watermark does not start, so the stream sees them SHIFT_DAYS later.  Each batch also lands a
marker row, so that empty batches run too; the last one's marker is at the end of time, which lets
the batch without data that follows it fire all timers.

Edge cases: a null ts is dropped; of rows of one click_id the smallest (arrived_at, ts, kind, value) counts, nulls first; each
distinct row without click_id counts and is dealt like the number of crc32('') (0); a null arrived_at is ts; a null kind is
'none'; a value that is null, not finite or beyond a long counts 0 cents; an empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexaudit.llm._util import table
from lexaudit.llm.sql_text import CRC_TABLE, crc32
from lexaudit.sources.shared import file_system, land, scratch, settings

BATCHES = 12
HOUR_MS, DAY_MS = 3_600_000, 86_400_000
HOUR_US, DAY_US = HOUR_MS * 1000, DAY_MS * 1000
#: A pane is due so long after its hour has ended, and closed so long after.
GRACE_MS, KEEP_MS = 2 * HOUR_MS, 3 * DAY_MS
#: Event times are moved by so many days, which brings any timestamp behind 1970; END_DAYS is behind any.
SHIFT_DAYS, END_DAYS = 10_000_000, 100_000_000
END_US = END_DAYS * DAY_US
#: Rows of closed panes go through so many lanes of a shard.
LANES = 64
#: Sums that a reading task holds before it passes them on.
MOST_SUMS = 100_000

CUT = "click_id long, kind string, at_us long, cents long"
SUMS = pa.schema([("kind", pa.string()), ("day", pa.int64()), ("lane", pa.int32()), ("hour", pa.int64()), ("click_id", pa.int64()), ("n_rows", pa.int64()), ("cents", pa.int64())])
OUT = "record string, kind string, hour long, click_id long, n_rows long, cents long"

STREAM_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # a start has one batch: its stores are closed, with their local files, once it is committed
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # a shard's state is a few KB; RocksDB takes an eighth of this at once, and what stores return lies in pieces between what
    # Spark does not return of each (statistics, 0.5 MB), so that executors grow with the number of stores opened
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "1",
    # the state is read again by this call alone, from a file system that checks its blocks itself: no second file for each
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
}
#: In a mounted folder Hadoop's FileContext, which Spark prefers, starts processes for each file of the state; FileSystem needs
#: fewer, and its rename is atomic there.  Other stores have what Spark takes for them.
MOUNTED = {"spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"}
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


class Panes(StatefulProcessor):
    """The panes of a kind and day.  Lanes from 0 on pass their rows through as late ones."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.panes = handle.getMapState("panes", "hour bigint", "n_rows bigint, cents bigint, written boolean")
        self.dirty = handle.getMapState("dirty", "hour bigint", "n_rows bigint, cents bigint")  # as last written
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kind, _, lane = key
        if lane >= 0:
            for r in rows:
                yield Row(record="late", kind=kind, hour=r.hour, click_id=r.click_id, n_rows=1, cents=r.cents)
            return
        new: dict[int, list[int]] = {}
        for r in rows:
            have = new.setdefault(r.hour, [0, 0])
            have[0] += r.n_rows
            have[1] += r.cents
        known = self._known()
        revised = False
        for hour, (n, cents) in new.items():
            n0, cents0, was = known.get(hour, (0, 0, False))
            if was and not self.dirty.containsKey((hour,)):
                self.dirty.updateValue((hour,), (n0, cents0))
            revised |= was
            known[hour] = (n0 + n, cents0 + cents, was)
            self.panes.updateValue((hour,), known[hour])
        now = timerValues.getCurrentWatermarkInMs()
        self._schedule(known, now - 1 if revised else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kind, now = key[0], timerValues.getCurrentWatermarkInMs()
        ended = now >= END_DAYS * DAY_MS
        known = self._known()
        dirty = {k[0]: tuple(v) for k, v in self.dirty.iterator()}
        self.dirty.clear()
        for hour in sorted(known):
            n, cents, was = known[hour]
            record = Row(record="final" if ended else "emit", kind=kind, hour=hour, click_id=-1, n_rows=n, cents=cents)
            if not was and (ended or now >= _end_ms(hour) + GRACE_MS):
                yield record
                known[hour] = (n, cents, True)
                self.panes.updateValue((hour,), known[hour])
            elif hour in dirty:
                old_n, old_cents = dirty[hour]
                yield Row(record="retract", kind=kind, hour=hour, click_id=-1, n_rows=old_n, cents=old_cents)
                yield Row(record="replace", kind=kind, hour=hour, click_id=-1, n_rows=n, cents=cents)
            if now >= _end_ms(hour) + KEEP_MS:
                self.panes.removeKey((hour,))
                del known[hour]
        self.timer.clear()  # the one that fired is taken away by Spark
        self._schedule(known)

    def close(self) -> None:
        pass

    def _known(self) -> dict[int, tuple[int, int, bool]]:
        return {k[0]: tuple(v) for k, v in self.panes.iterator()}

    def _schedule(self, known: dict[int, tuple[int, int, bool]], at: int | None = None) -> None:
        """One timer: at, or the earliest deadline of a known pane.  Timers fire once the watermark is beyond them."""
        if at is None and known:
            at = min(_end_ms(h) + (KEEP_MS if was else GRACE_MS) - 1 for h, (_, _, was) in known.items())
        old = self.timer.get()[0] if self.timer.exists() else None
        if at == old:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if at is None:
            self.timer.clear()
            return
        self.handle.registerTimer(at)
        self.timer.update((at,))


def _end_ms(hour: int) -> int:
    """The end of an hour on the stream's clock."""
    return (hour + 1) * HOUR_MS + SHIFT_DAYS * DAY_MS


def _sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of closed panes as they are, others summed by kind and hour within the task."""
    held: dict[tuple[str, int], list[int]] = {}

    def out() -> pa.RecordBatch:
        keys = list(held)
        cols = [[k[0] for k in keys], [k[1] // 24 for k in keys], [-1] * len(keys), [k[1] for k in keys], [-1] * len(keys), [held[k][0] for k in keys], [held[k][1] for k in keys]]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SUMS, strict=True)], schema=SUMS)

    for p in parts:
        closed = p["lane"].to_numpy(zero_copy_only=False) >= 0
        if closed.any():
            yield p.filter(pa.array(closed)).select(SUMS.names).cast(SUMS)
        rest = pa.Table.from_batches([p]).filter(pa.array(~closed)).group_by(["kind", "hour"]).aggregate([("n_rows", "sum"), ("cents", "sum")])
        for kind, hour, n, cents in zip(*(rest[c].to_pylist() for c in ("kind", "hour", "n_rows_sum", "cents_sum")), strict=True):
            have = held.setdefault((kind, hour), [0, 0])
            have[0] += n
            have[1] += cents
        if len(held) >= MOST_SUMS:
            yield out()
    if held:
        yield out()


def micros(c: str) -> Column:
    """Microseconds since 1970 of a timestamp by its own calendar, whatever the session's zone."""
    return F.datediff(F.col(c), F.lit("1970-01-01").cast("date")).cast("long") * DAY_US + F.hour(c).cast("long") * HOUR_US + F.minute(c).cast("long") * 60_000_000 + (F.date_part(F.lit("SECOND"), F.col(c)) * 1_000_000).cast("long")


def cut(clicks: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(batch, click_id, kind, at_us, cents) of each click once; at_us is the event time on the stream's clock."""
    c = clicks.select(F.col("click_id").cast("long"), "ts", F.coalesce("arrived_at", "ts").alias("arrived_at"), "kind", F.col("value").cast("double")).where("ts IS NOT NULL")
    row = F.struct("arrived_at", "ts", "kind", "value")
    c = c.groupBy("click_id", F.when(F.col("click_id").isNull(), row).alias("_alone")).agg(F.min(row).alias("_r")).select("click_id", "_r.*")
    day = F.datediff("arrived_at", F.lit("1970-01-01").cast("date"))
    q = F.pmod(day, F.lit(batches))
    late = F.greatest(F.lit(0), F.crc32(F.coalesce(F.col("click_id").cast("string"), F.lit(""))) % 30 - 23)
    scaled = F.col("value") * 100 + 0.5
    cents = F.when(F.abs(scaled) < 9e18, F.floor(F.when(F.abs(scaled) < 9e18, scaled).otherwise(0.0))).otherwise(0)
    return c.select(
        F.least(F.lit(batches - 1), q + late).cast("int").alias("batch"),
        "click_id",
        F.coalesce("kind", F.lit("none")).alias("kind"),
        (micros("ts") - (day - q).cast("long") * DAY_US + SHIFT_DAYS * DAY_US).alias("at_us"),
        F.coalesce(cents, F.lit(0)).cast("long").alias("cents"),
    )


def revised_panes(clicks: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(batch, record, kind, hour, click_id, n_rows, cents): all that the query writes over the batches, started once for each."""
    spark = clicks.sparkSession
    at = scratch(spark, "panes")
    marks = spark.range(batches).select(F.col("id").cast("int").alias("batch"), F.lit(None).cast("long").alias("click_id"), F.lit("").alias("kind"), F.when(F.col("id") == batches - 1, F.lit(END_US)).otherwise(F.lit(0)).alias("at_us"), F.lit(0).cast("long").alias("cents"))
    cut(clicks, batches).unionByName(marks).write.partitionBy("batch").parquet(f"{at}/cut")
    real = spark.read.schema(f"{CUT}, batch int").parquet(f"{at}/cut").where((F.col("at_us") > 0) & (F.col("at_us") < END_US))
    last = {r["batch"]: r["m"] for r in real.groupBy("batch").agg(F.max("at_us").alias("m")).collect()}
    seen = 0  # the largest event time of earlier batches; none is before all
    chosen = _stream_settings(file_system(spark, at)[0].getScheme())

    for k in range(batches):
        land(spark, f"{at}/cut/batch={k}", f"{at}/in/batch={k}")
        with settings(spark, chosen | {NO_DATA: "true" if k == batches - 1 else "false"}):
            q = _panes(spark.readStream.schema(CUT).parquet(f"{at}/in/*"), seen).writeStream.foreachBatch(_keep(f"{at}/out")).outputMode("append").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
            q.awaitTermination()
        seen = max(seen, last.get(k, 0))
    out = spark.read.schema(f"{OUT}, epoch int").parquet(f"{at}/out")
    return out.select(F.least("epoch", F.lit(batches - 1)).cast("long").alias("batch"), "record", "kind", "hour", "click_id", "n_rows", "cents")


def _stream_settings(scheme: str) -> dict[str, str]:
    """What a start is made with, its checkpoint being in a file system of this scheme."""
    return STREAM_SETTINGS | (MOUNTED if scheme == "file" else {})


def _panes(rows: DataFrame, seen: int) -> DataFrame:
    """The stream of records of a stream of cut rows; seen is the largest event time of earlier batches."""
    rows = rows.withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", "0 seconds")
    # the condition is on the watermark's column, so that markers pass the watermark first
    rows = rows.where((F.col("at") > F.timestamp_micros(F.lit(0))) & (F.col("at") < F.timestamp_micros(F.lit(END_US))))
    rows = rows.withColumn("hour", F.expr(f"at_us div {HOUR_US}") - SHIFT_DAYS * 24)
    closed = F.lit(seen) >= (F.col("hour") + (1 + SHIFT_DAYS * 24)) * HOUR_US + KEEP_MS * 1000
    lane = F.when(closed, F.pmod(F.xxhash64("click_id", "at_us"), F.lit(LANES)).cast("int")).otherwise(-1)
    rows = rows.select("kind", F.floor(F.col("hour") / 24).alias("day"), lane.alias("lane"), "hour", "click_id", F.lit(1).cast("long").alias("n_rows"), "cents")
    sums = rows.mapInArrow(_sums, "kind string, day long, lane int, hour long, click_id long, n_rows long, cents long")
    return sums.groupBy("kind", "day", "lane").transformWithState(Panes(), OUT, "Append", "EventTime")


def _keep(path: str):
    """Writes each micro-batch as a folder of its own; a batch that is repeated after a failure overwrites its own rows."""

    def keep(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return keep


def op13_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """revised_panes of all clicks in twelve batches; edge cases as stated above."""
    return revised_panes(table(spark, sf_dir, "clicks"))


#: The same records in closed form: the batch from which each pane is due and closed follows from the running maximum of event times.
OP13_SQL = f"""
WITH {CRC_TABLE},
once AS (SELECT DISTINCT ON (click_id, CASE WHEN click_id IS NULL THEN (arrived, ts, kind, value) END) click_id, ts, arrived, kind, value
         FROM (SELECT click_id, ts, coalesce(arrived_at, ts) AS arrived, kind, value FROM clicks WHERE ts IS NOT NULL)
         ORDER BY click_id, CASE WHEN click_id IS NULL THEN (arrived, ts, kind, value) END, arrived, ts, kind NULLS FIRST, value NULLS FIRST),
dealt AS (SELECT *, datediff('day', DATE '1970-01-01', arrived::DATE) AS d FROM once),
placed AS (SELECT click_id, coalesce(kind, 'none') AS kind,
                  least({BATCHES - 1}, ((d % {BATCHES}) + {BATCHES}) % {BATCHES} + greatest(0, {crc32("coalesce(click_id::VARCHAR, '')")}::BIGINT % 30 - 23)) AS batch,
                  epoch_us(ts) - (d - ((d % {BATCHES}) + {BATCHES}) % {BATCHES})::BIGINT * {DAY_US} AS et,
                  CASE WHEN abs(100 * value + 0.5) < 9e18 THEN floor(100 * value + 0.5)::BIGINT ELSE 0 END AS cents
           FROM dealt, crc),
r AS (SELECT *, ((et - ((et % {HOUR_US}) + {HOUR_US}) % {HOUR_US}) // {HOUR_US}) AS hour FROM placed),
w AS (SELECT k.batch, (SELECT max(r.et) FROM r WHERE r.batch < k.batch) AS w FROM range({BATCHES}) k(batch)),
pane AS (SELECT kind, hour, (SELECT min(batch) FROM w WHERE w.w >= (hour + 1) * {HOUR_US} + {GRACE_MS * 1000}) AS due,
                (SELECT min(batch) FROM w WHERE w.w >= (hour + 1) * {HOUR_US} + {KEEP_MS * 1000}) AS closed
         FROM (SELECT DISTINCT kind, hour FROM r)),
x AS (SELECT r.*, pane.due, coalesce(r.batch >= pane.closed, false) AS late FROM r JOIN pane USING (kind, hour)),
step AS (SELECT kind, hour, due, batch, sum(n) OVER k AS n_rows, sum(c) OVER k AS cents, lag(batch) OVER (PARTITION BY kind, hour ORDER BY batch) AS before,
                lead(batch) OVER (PARTITION BY kind, hour ORDER BY batch) AS after
         FROM (SELECT kind, hour, due, batch, count(*) AS n, sum(cents) AS c FROM x WHERE NOT late GROUP BY ALL)
         WINDOW k AS (PARTITION BY kind, hour ORDER BY batch)),
first AS (SELECT kind, hour, greatest(due, batch) AS batch, n_rows, cents FROM step WHERE due IS NOT NULL AND (after IS NULL OR after > due) AND (before IS NULL OR batch <= due))
SELECT batch::BIGINT AS batch, 'late' AS record, kind, hour::BIGINT AS hour, click_id::BIGINT AS click_id, 1::BIGINT AS n_rows, cents::BIGINT AS cents FROM x WHERE late
UNION ALL SELECT batch, 'emit', kind, hour, -1, n_rows, cents FROM first
UNION ALL SELECT step.batch, 'replace', kind, hour, -1, step.n_rows, step.cents FROM step JOIN first USING (kind, hour) WHERE step.batch > first.batch
UNION ALL SELECT after, 'retract', kind, hour, -1, step.n_rows, step.cents FROM step JOIN first USING (kind, hour) WHERE step.after > first.batch
UNION ALL SELECT {BATCHES - 1}, 'final', kind, hour, -1, n_rows, cents FROM step WHERE due IS NULL AND after IS NULL
"""
