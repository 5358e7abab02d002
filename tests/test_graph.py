"""Closures longer than ten steps, and components of any shape in few rounds."""

import random

from pyspark.sql import functions as F

from lexaudit.operators import graph
from lexaudit.plans import matching


def test_reachable_has_no_bound(spark):
    chain = [(i, i + 1) for i in range(13)]
    cycle = [(100 + i, 100 + (i + 1) % 3) for i in range(3)]
    e = spark.createDataFrame([*chain, *cycle], "a long, b long")
    got = {(r.source, r.target): r.steps for r in graph.reachable(e, "a", "b").collect()}
    want = {(i, j): j - i for i in range(14) for j in range(i + 1, 14)}
    assert got == want | {(100 + i, 100 + (i + k) % 3): k for i in range(3) for k in (1, 2, 3)}
    assert max(r.steps for r in graph.reachable(e, "a", "b", 4).collect()) == 4


def test_long_chains_settle_in_few_rounds(spark):
    """A chain in order, one out of order, a hub that is its largest node, and a tree: eight rounds are enough."""
    rnd = random.Random(3)
    mixed = rnd.sample(range(2000, 2300), 300)
    tree = [(5000 + i, 5000 + (i - 1) // 2) for i in range(1, 200)]
    rows = [(i, i + 1) for i in range(600)] + list(zip(mixed, mixed[1:], strict=False)) + [(4000, i) for i in range(3900, 4000)] + tree
    got = dict(graph.connected_components(spark.createDataFrame(rows, "a long, b long"), "a", "b", max_rounds=8).collect())
    want = {i: 0 for i in range(601)} | {i: 2000 for i in mixed} | {i: 3900 for i in range(3900, 4001)} | {i: 5000 for i in range(5000, 5200)}
    assert got == want


def test_few_edges_are_sent_and_many_are_shuffled(spark, monkeypatch):
    """The groups are the same; a small graph's pointers are looked up without a shuffle for each join."""
    rows = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)]
    e = spark.createDataFrame(rows, "a long, b long")
    sent = []
    own = graph._ends
    monkeypatch.setattr(graph, "_ends", lambda up, f: sent.append("broadcast" in f(up)._jdf.queryExecution().logical().toString().lower()) or own(up, f))
    few = dict(graph.connected_components(e, "a", "b").collect())
    monkeypatch.setattr(graph, "FEW", 10)
    assert few == dict(graph.connected_components(e, "a", "b").collect()) == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert sent == [True, False]


def test_groups_send_no_table_of_entries(spark, monkeypatch):
    """No side of a join is sent to all tasks, however small its files are; up to the components, which send few edges on purpose."""
    plans, plan = [], lambda df: df._jdf.queryExecution().executedPlan().toString()
    own = graph.written
    monkeypatch.setattr(graph, "written", lambda df, tag: plans.append(plan(df)) or own(df, tag))
    rounds = lambda edges, a, b: plans.append(plan(edges)) or edges.select(F.col(a).alias("node"), F.col(a).alias("component"))
    monkeypatch.setattr(graph, "connected_components", rounds)
    plans.append(plan(matching.grouped_entries(spark, "/root/testdata/sf0.001")))
    assert len(plans) == 3
    assert all("Join" in p and "BroadcastHashJoin" not in p for p in plans)
