"""op13 against a plain program that follows the rules batch by batch."""

from __future__ import annotations

import datetime as dt
import math
import random
import zlib
from collections import defaultdict

from pyspark.sql.streaming import DataStreamWriter

from lexaudit.llm import panes

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, batch string"
EPOCH = dt.datetime(1970, 1, 1)
HOUR = dt.timedelta(hours=1)


def plain(rows, batches):
    """All records, batch by batch; rows are (click_id, ts, arrived_at, kind, value)."""
    order = lambda r: tuple((x is not None, 0 if x is None else x) for x in r)
    once = {}
    for click_id, ts, arrived, kind, value in rows:
        if ts is None:
            continue
        row = (arrived or ts, ts, kind, value)
        key = (click_id, row if click_id is None else None)
        if key not in once or order(row) < order(once[key]):
            once[key] = row
    dealt = defaultdict(list)
    for (click_id, _), (arrived, ts, kind, value) in once.items():
        day = (arrived - EPOCH).days
        q = day % batches
        crc = zlib.crc32(str(click_id).encode()) if click_id is not None else 0
        b = min(batches - 1, q + max(0, crc % 30 - 23))
        cents = math.floor(100 * value + 0.5) if value is not None and math.isfinite(value) and abs(100 * value + 0.5) < 9e18 else 0
        dealt[b].append((click_id, kind or ("none" if kind is None else ""), ts - dt.timedelta(days=day - q), cents))
    out, open_, mark = [], {}, None
    for b in range(batches):
        reached = lambda hour, more: mark is not None and mark >= EPOCH + HOUR * (hour + 1) + more  # noqa: B023, E731
        dirty = {}
        for click_id, kind, at, cents in dealt[b]:
            hour = (at - EPOCH) // HOUR
            if reached(hour, dt.timedelta(days=3)):
                out.append((b, "late", kind, hour, click_id, 1, cents))
                continue
            p = open_.setdefault((kind, hour), [0, 0, False])
            if p[2]:
                dirty.setdefault((kind, hour), (p[0], p[1]))
            p[0] += 1
            p[1] += cents
        for (kind, hour), p in sorted(open_.items()):
            if (kind, hour) in dirty:
                out.append((b, "retract", kind, hour, -1, *dirty[kind, hour]))
                out.append((b, "replace", kind, hour, -1, p[0], p[1]))
            if not p[2] and reached(hour, 2 * HOUR):
                out.append((b, "emit", kind, hour, -1, p[0], p[1]))
                p[2] = True
            if reached(hour, dt.timedelta(days=3)):
                del open_[kind, hour]
        mark = max([x for x in (mark, *(at for _, _, at, _ in dealt[b])) if x is not None], default=None)
    out += [(batches - 1, "final", kind, hour, -1, p[0], p[1]) for (kind, hour), p in open_.items() if not p[2]]
    return out


def made(n, seed):
    """Rows on whole hours, so that watermarks meet deadlines exactly, with nulls, repeats and odd values."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        arrived = dt.datetime(2024, 1, 1) + dt.timedelta(hours=r.randrange(24 * 30), microseconds=r.choice([0, 0, 1, 999_999]))
        ts = arrived.replace(microsecond=0) - HOUR * r.choice([0, 0, 0, 1, 2, 3, 24, 71, 72, 75, 100])
        rows.append((i, ts, arrived, r.choice(["a", "a", "b", None, "none", ""]), r.choice([1.005, -0.005, 2.5, None, float("inf"), 1e300, -7.25])))
    rows += rows[:20] + [(7, ts, arrived, "z", 0.0) for _, ts, arrived, _, _ in rows[:3]]  # repeats, and other rows of one id
    day = dt.datetime(2024, 1, 9, 5)
    rows += [(None, day, day, "a", 1.0), (None, day, day, "a", 1.0), (None, day, day, "a", 2.0), (9001, None, day, "a", 1.0), (9002, day, None, "a", 1.0)]
    rows += [(9003, dt.datetime(1969, 12, 31, 22), dt.datetime(1969, 12, 31, 23), "old", 1.0), (9004, dt.datetime(200, 1, 1), day, "old", 1.0)]
    return rows


def records(spark, rows, batches):
    df = spark.createDataFrame([(c, ts, at, 1, kind, value, "{}", "clash") for c, ts, at, kind, value in rows], SCHEMA)
    out = panes.revised_panes(df, batches)
    assert out.columns == ["batch", "record", "kind", "hour", "click_id", "n_rows", "cents"]
    return [tuple(r) for r in out.collect()]


def test_against_plain_program(spark):
    rows = made(400, 5)
    want = plain(rows, 12)
    assert {r[1] for r in want} == {"late", "emit", "retract", "replace", "final"}
    assert min(r[3] for r in want) < 0
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(records(spark, rows, 12), key=key) == sorted(want, key=key)


def test_empty_batches_emit_and_settings_come_back(spark):
    """Batch 1 of 4 has no rows: it still emits what batch 0 made due."""
    before = spark.conf.get(panes.NO_DATA, None)
    day = dt.datetime(1970, 1, 1)
    clicks = [i for i in range(200) if zlib.crc32(str(i).encode()) % 30 <= 23][:3]
    rows = [(clicks[0], day, day, "a", 1.0), (clicks[1], day + 5 * HOUR, day, "a", 1.0), (clicks[2], day + 50 * HOUR, day + 50 * HOUR, "a", 1.0)]
    want = plain(rows, 4)
    assert (1, "emit", "a", 0, -1, 1, 100) in want
    assert sorted(records(spark, rows, 4)) == sorted(want)
    assert spark.conf.get(panes.NO_DATA, None) == before


def test_empty_table(spark):
    assert records(spark, [], 2) == []


def test_state_has_one_file_for_each_batch_and_shard(spark, tmp_path, monkeypatch):
    """Few files, as each costs a start of processes in a mounted folder; other stores keep Spark's own way of writing."""
    monkeypatch.setattr(panes, "scratch", lambda _, tag: f"file://{tmp_path}/{tag}")
    records(spark, made(50, 7), 2)
    state = [p for p in (tmp_path / "panes/checkpoint/state/0").rglob("*.changelog*") if not p.name.startswith(".")]
    assert state
    assert all(p.suffix == ".changelog" for p in state)
    name = "spark.sql.streaming.checkpointFileManagerClass"
    assert name in panes._stream_settings("file")
    assert not any(name in panes._stream_settings(s) for s in ("hdfs", "s3a", "viewfs"))


def test_open_stores_take_little_memory(spark, monkeypatch):
    """Below half a MB each: executors open one for each shard and start, and native memory once taken comes back in part only."""
    begun, start = [], DataStreamWriter.start
    monkeypatch.setattr(DataStreamWriter, "start", lambda self, *a, **b: begun.append(start(self, *a, **b)) or begun[-1])
    records(spark, made(400, 9), 2)
    used = [op["memoryUsedBytes"] / op["numShufflePartitions"] for q in begun for p in q.recentProgress for op in p["stateOperators"]]
    assert used
    assert max(used) < 500_000
