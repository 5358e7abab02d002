"""Names in texts by a trie, and lists with one element left out, against plain loops."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from lexaudit.operators import dictionary, joins


def tokens(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def plain(docs, names):
    known = {tuple(tokens(n)) for n in names if tokens(n)}
    every, kept = [], []
    for i, text in docs:
        w = tokens(text)
        hits = sorted((a, -z) for a in range(len(w)) for z in range(a + 1, len(w) + 1) if tuple(w[a:z]) in known)
        every += [(i, a, -z, " ".join(w[a:-z])) for a, z in hits]
        end = 0
        for a, z in hits:
            if a >= end:
                end = -z
                kept.append((i, a, -z, " ".join(w[a:-z])))
    return every, kept


def test_against_a_plain_search(spark):
    r = random.Random(5)
    pick = lambda n: " ".join(r.choice("abc") for _ in range(n))
    names = [pick(r.choice([1, 2, 3, 5, 9])) for _ in range(12)] + ["a b", "A  B!", "", "b a c a b", "x y z"]
    docs = [(i, pick(r.randrange(40))) for i in range(30)] + [(100, None), (101, ""), (102, "A,b a-b X y"), (103, "x y")]
    d, n = spark.createDataFrame(docs, "id int, t string"), spark.createDataFrame([(x,) for x in names], "name string")
    hits = dictionary.occurrences(d, "id", "t", n)
    every, kept = plain(docs, names)
    row = lambda df: sorted(tuple(x) for x in df.select("id", "start", "end", "name").collect())
    assert row(hits) == sorted(every)
    assert row(dictionary.leftmost_longest(hits, "id")) == sorted(kept)
    assert sorted(tuple(x) for x in joins.find_names(d, "id", "t", n, 2).collect()) == sorted((i, a, x) for i, a, _, x in plain(docs, [x for x in names if len(tokens(x)) <= 2])[1])


def test_nothing_to_find(spark):
    d, n = spark.createDataFrame([(1, "a b")], "id int, t string"), spark.createDataFrame([("q",)], "name string")
    assert dictionary.occurrences(d, "id", "t", n).columns == ["id", "start", "end", "name"]
    assert dictionary.leftmost_longest(dictionary.occurrences(d, "id", "t", n), "id").isEmpty()
    assert joins.find_names(d, "id", "t", n.limit(0), 3).isEmpty()


def test_dead_prefixes_end_early(spark):
    """Only places that start a name are walked: the second round has the rows of live prefixes alone."""
    d = spark.createDataFrame([(i, "a x " * 50) for i in range(4)], "id int, t string")
    edges = dictionary.trie(spark.createDataFrame([("a b c d e f g h",), ("a x",)], "name string"))
    assert edges.where("node = ''").count() == 1 and edges.where("ends").count() == 2
    assert dictionary.occurrences(d, "id", "t", spark.createDataFrame([("a b c d e f g h",), ("a x",)], "name string")).count() == 200


def test_one_left_out(spark):
    r = random.Random(4)
    lists = [[r.choice("ab") for _ in range(r.randrange(5))] for _ in range(40)] + [["a\x1f", "b"], ["a", "\x1fb"], ["a", None]]
    rows = [(i, i % 3, x) for i, x in enumerate(lists)] + [(900, 0, None)]
    df = spark.createDataFrame(rows, "id int, g int, x array<string>")
    got = joins.one_left_out(df, df.select("g", F.col("id").alias("o"), F.col("x").alias("y")), ["g"], "x", "y")
    want = {(a, b) for a, g, x in rows for b, h, y in rows if g == h and x is not None and y is not None and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))}
    found = [(p["id"], p["o"]) for p in got.collect()]
    assert set(found) == want and len(found) == len(want)
    assert "id = " not in got._jdf.queryExecution().optimizedPlan().toString()
