"""Values carried down and as-of joins where one key has most rows."""

import random

from pyspark.sql import functions as F

from lexaudit.operators import joins, windows


def carried(rows):
    last, out = {}, []
    for k, at, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        last[k] = v if v is not None else last.get(k)
        out.append((k, at, last[k]))
    return out


def test_carry_down_over_ranges(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None]), i, rng.choice([None] * 40 + [i])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, at int, v int").repartition(5)
    for n in (1, 7, 64):
        got = [tuple(r) for r in windows.carry_down(df, "v", ["k"], ["at"], partitions=n).collect()]
        assert sorted(got, key=str) == sorted(carried(rows), key=str)
    down = windows.carry_down(df, "v", ["k"], [F.col("at").desc()], partitions=7).collect()
    assert sorted(map(tuple, down), key=str) == sorted(((k, -a, v) for k, a, v in carried([(k, -a, v) for k, a, v in rows])), key=str)


def test_carry_down_empty(spark):
    none = spark.createDataFrame([], "k string, at int, v int")
    assert windows.carry_down(none, "v", ["k"], ["at"]).collect() == []


def test_as_of_hot_key(spark):
    left = spark.createDataFrame([("hot", i * 3, i) for i in range(700)] + [("lone", 5, -1)], "k string, at int, id int")
    right = spark.createDataFrame([("hot", i * 50 + 1, i) for i in range(30)] + [("hot", 1, 99)], "k string, at int, v int")
    want = [(1, 99)] + [(i * 50 + 1, i) for i in range(1, 30)]
    got = {r.id: r.v for r in joins.as_of(left, right, by=["k"], at="at", value="v", out="v").collect()}
    assert got == {**{i: max((x for x in want if x[0] <= i * 3), default=(0, None))[1] for i in range(700)}, -1: None}
    got = {r.id: r.v for r in joins.as_of(left, right, by=["k"], at="at", value="v", out="v", forward=True).collect()}
    assert got == {**{i: min((x for x in want if x[0] >= i * 3), default=(0, None))[1] for i in range(700)}, -1: None}
