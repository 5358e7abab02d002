"""A local session for all tests, and a comparison with DuckDB."""

from __future__ import annotations

import glob
import math
import os

import pytest
from pyspark.sql import SparkSession

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.driver.memory", "3g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 7)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def in_order(rows):
    return sorted((tuple(plain(x) for x in r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.fixture(scope="session")
def agree(spark, duck):
    """agree(query, sql): both give the same columns and rows over the small tables."""

    def check(query, sql):
        got = query(spark, SF)
        cur = duck.execute(sql)
        names = [x[0] for x in cur.description]
        assert sorted(names) == sorted(got.columns)
        assert in_order(got.select(*names).collect()) == in_order(cur.fetchall())

    return check
