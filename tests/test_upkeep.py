"""Publication in one step, and values kept up to date after changes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexaudit.operators import upkeep
from lexaudit.plans import keeping
from lexaudit.sources.publish import Conflict, Published

TERMS = "part string, group string, name string, reads string, coef double"


def plain(terms):
    """(group, name) -> value or problem, by recursion."""
    by = {}
    for _, g, n, r, c in terms:
        by.setdefault((g, n), []).append((r, c))

    def value(g, n, path):
        if (g, n) in path or (g, n) not in by:
            return None
        parts = [c if r is None else (lambda v, c=c: None if v is None else v * c)(value(g, r, path | {(g, n)})) for r, c in by[g, n]]
        return None if None in parts else sum(parts)

    def problem(g, n):
        missing = sorted(r for r, _ in by[g, n] if r is not None and (g, r) not in by)
        return f"reads {missing[0]}, which is not defined" if missing else upkeep.CIRCULAR

    out = {}
    for g, n in by:
        v = value(g, n, frozenset())
        out[g, n] = (None if v is None else round(v, 6), problem(g, n) if v is None else None)
    return out


def made(r, groups=12):
    terms = []
    for g in range(groups):
        names = [f"n{i}" for i in range(8)]
        for i, n in enumerate(names):
            reads = r.sample(names[:i], min(i, r.randrange(3))) + r.choice([[], [], [None]])
            if r.random() < 0.06:
                reads.append(r.choice([*names, "nowhere"]))  # circles and names that are not there
            for x in reads or [None]:
                terms.append((f"p{g % 3}", f"g{g}", n, x, float(r.randrange(1, 5))))
    return [*terms, *terms[:2], ("p0", "g0", "c1", "c2", 1.0), ("p0", "g0", "c2", "c1", 1.0), ("p0", "g0", "c3", "c1", 1.0)]


def results(store, version=None):
    return {(r["group"], r["name"]): (None if r["value"] is None else round(r["value"], 6), r["problem"]) for r in store.read("results", version).collect()}


def test_changes_give_what_a_new_evaluation_gives(spark, tmp_path):
    r = random.Random(11)
    terms = made(r)
    store = Published(spark, f"file://{tmp_path}/kept")
    upkeep.create(store, spark.createDataFrame(terms, TERMS))
    assert results(store) == plain(terms)
    assert any(p == upkeep.CIRCULAR for _, p in results(store).values())
    for _ in range(2):
        changed = {(g, n): p for p, g, n, _, _ in r.sample([t for t in terms if t[0] != "p2"], 4)}
        edits = [(p, g, n, None, 9.0) for (g, n), p in changed.items()]
        edits[0] = (*edits[0][:3], "n0", 2.0)
        edits[1] = (*edits[1][:4], None)  # taken away
        edits.append(("p0", "new", "n0", None, 1.5))
        before = store.entry()["tables"]["results"]["folders"]["p2"]
        upkeep.apply_edits(store, spark.createDataFrame(edits, TERMS))
        names = {(e[1], e[2]) for e in edits}
        terms = [t for t in terms if (t[1], t[2]) not in names] + [e for e in edits if e[4] is not None]
        assert results(store) == plain(terms)
        assert store.entry()["tables"]["results"]["folders"]["p2"] == before  # a part without changes is not written again
    assert upkeep.apply_edits(store, spark.createDataFrame([], TERMS)) == store.version() == 3


def test_only_touched_parts_are_opened(spark, tmp_path):
    store = Published(spark, f"file://{tmp_path}/kept")
    upkeep.create(store, spark.createDataFrame(made(random.Random(2)), TERMS))
    some = store.read("results", parts=["p1"])
    files = {r[0] for r in some.select(F.input_file_name()).distinct().collect()}
    assert files and all("part=p1" in f for f in files)
    assert "PartitionFilters: [isnotnull(part" in some._jdf.queryExecution().toString()
    assert store.read("results", parts=[]).isEmpty()


def test_only_readers_are_reached(spark):
    terms = [("p", "g", "a", None, 1.0), ("p", "g", "b", "a", 1.0), ("p", "g", "c", "b", 1.0), ("p", "g", "d", None, 1.0), ("p", "h", "b", "a", 1.0), ("p", "g", "a", "c", 1.0)]
    t = spark.createDataFrame(terms, TERMS)
    got = {tuple(r) for r in upkeep.reached(t.where("name = 'b'").select("group", "name"), t).collect()}
    assert got == {("g", "b"), ("h", "b"), ("g", "c"), ("g", "a")}


def test_publication_is_whole_or_not_at_all(spark, tmp_path):
    store = Published(spark, f"file://{tmp_path}/p")
    a = spark.range(5)
    assert store.version() == 0 and store.entry()["tables"] == {}
    assert store.publish({"a": a, "b": a.withColumn("x", F.lit(1))}, {"rows": 5}) == 1
    with pytest.raises(Exception, match="stop"):
        store.publish({"a": spark.range(9), "b": a.select("id", F.when(F.col("id") == 3, F.raise_error(F.lit("stop"))).otherwise(1).alias("x"))})
    assert (store.version(), store.read("a").count(), store.entry()["summary"]) == (1, 5, {"rows": 5})
    reader = store.read("a")
    assert store.publish({"a": spark.range(7)}) == 2
    assert (reader.count(), store.read("a").count(), store.read("a", 1).count(), store.read("b").count()) == (5, 7, 5, 5)
    with pytest.raises(Conflict):
        store.publish({"a": spark.range(1)}, based_on=1)
    assert store.read("a").count() == 7
    assert len(store.prune(keep=2)) == 3  # both of the failed job and that of the writer who came second
    assert (store.read("a", 1).count(), store.read("b").count()) == (5, 5)
    assert len(store.prune(keep=1)) == 1
    assert (store.read("a").count(), store.read("b").count()) == (7, 5)


@pytest.mark.parametrize("name", keeping.QUERIES)
def test_queries(agree, name):
    agree(keeping.QUERIES[name], keeping.SQL[name])
