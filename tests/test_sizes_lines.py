"""Exact medians by counting, counters beside rows, and lines that cannot be read."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexaudit.operators import aggregates
from lexaudit.sources import files


@pytest.mark.parametrize("kind", ["long", "double"])
def test_medians(spark, kind):
    r = random.Random(7)
    draw = {"long": [lambda: r.randrange(-50, 50), lambda: r.choice([-(2**62), 2**62, 0, 1]), lambda: 7], "double": [lambda: r.gauss(0, 1e-3), lambda: r.choice([-1e308, 1e308, 1e-308, 0.0]), lambda: 0.1]}[kind]
    rows = [(g, r.choice(["a", "b"]), draw[(g or 0) % 3]()) for g in [None, 0, 1, 2, 3, 4] for _ in range(r.choice([1, 2, 301, 400]))]
    rows += [(9, "a", None), (0, "a", None)] + ([(1, "a", float("nan"))] if kind == "double" else [])
    df = spark.createDataFrame(rows, f"g int, h string, x {kind}").repartition(5)
    want = {}
    for g, h, x in rows:
        if x is not None and x == x:
            want.setdefault((g, h), []).append(x)
    got = {(m["g"], m["h"]): m["median"] for m in aggregates.medians(df, "x", ["g", "h"]).collect()}
    assert got == pytest.approx({k: statistics.median(map(float, v)) for k, v in want.items()}, nan_ok=True)
    total = [x for v in want.values() for x in v]
    assert aggregates.medians(df, "x").first()[0] == pytest.approx(statistics.median(map(float, total)))
    assert [tuple(s) for s in aggregates.sizes(df.where("g = 9"), "x", ["g"]).collect()] == [(9, 0, None, None, None)]
    assert aggregates.medians(df.limit(0), "x", ["g"]).isEmpty()


def test_counters_come_from_the_job_that_writes(spark, tmp_path):
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "")
    got = files.write_counted(spark.range(100), lambda df: df.write.parquet(f"{tmp_path}/out"), {"n": F.count(F.lit(1)), "even": F.count_if(F.col("id") % 2 == 0)})
    assert len(jobs.getJobIdsForGroup("counted")) == 1
    spark.sparkContext.setJobGroup("other", "")
    assert got == {"n": 100, "even": 50} and spark.read.parquet(f"{tmp_path}/out").count() == 100


def test_lines_that_cannot_be_read(spark, tmp_path):
    """Blank lines, other types, lists and halves, in files that are cut into many blocks."""
    schema = StructType.fromDDL("a long, b array<string>")
    lines = ['{"a":1,"b":["x"]}', "", '{"a":"one"}', "   ", "[1]", '{"a":2}', "null", "3", '{"a":3,"b":"x"}', '{"c":1}', '{"a":4', "{}"]
    (tmp_path / "one.json").write_text("\n".join(lines) + "\n")
    many = [f'{{"a":{i}}}' if i % 10 else f"broken {i}" for i in range(2000)]
    (tmp_path / "two.json").write_text("\n".join(many))
    (tmp_path / "none.json").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        good, bad = files.readable_lines(spark, f"{tmp_path}/*.json", schema)
        assert bad.select("file").rdd.getNumPartitions() > 1
        rows = [tuple(r) for r in bad.select(F.substring_index("file", "/", -1), "line", "text").collect()]
        assert sorted(r for r in rows if r[0] == "one.json") == [("one.json", i + 1, lines[i]) for i in (2, 4, 6, 7, 8, 10)]
        assert sorted(r for r in rows if r[0] == "two.json") == [("two.json", i + 1, many[i]) for i in range(0, 2000, 10)]
        assert good.count() == 4 + 1800 and good.columns == ["a", "b"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
