"""Attempts go on where an earlier start has left them."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from lexaudit.streaming import attempts


def at(minute):
    return datetime(2024, 1, 1, 0, minute, tzinfo=UTC)


def test_each_start_goes_on_at_the_attempt_it_was_at(spark, tmp_path):
    root = f"file://{tmp_path}/a"
    rows = [(str(i), json.dumps({"fails": f, "uses": u})) for i, (f, u) in enumerate([(0, 5), (1, 5), (2, None), (9, 1)])]
    df = spark.createDataFrame([*rows, rows[0], (None, "{}")], "id string, text string")
    found = lambda: {r["id"]: (r["attempts"], r["used"], r["answer"], r["failed"]) for r in attempts.settled(spark, root).collect()}
    attempts.start(spark, root, df, at(0), attempts.flaky)
    assert found() == {"0": (1, 6, "answer 1", False)}
    attempts.start(spark, root, None, at(0), attempts.flaky)  # too early for a second attempt
    assert set(found()) == {"0"}
    attempts.start(spark, root, df, at(1), attempts.flaky)  # known records are not begun again
    assert found() == {"0": (1, 6, "answer 1", False), "1": (2, 13, "answer 2", False)}
    attempts.start(spark, root, None, at(3), attempts.flaky)
    assert found() == {"0": (1, 6, "answer 1", False), "1": (2, 13, "answer 2", False), "2": (3, None, "answer 3", False), "3": (3, 9, None, True)}


def test_query(agree):
    agree(attempts.QUERIES["resumed_attempts"], attempts.SQL["resumed_attempts"])
