"""Evaluation of groups in their task, and level by level where a group is too large for that."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexaudit.operators import upkeep
from lexaudit.plans import keeping
from lexaudit.sources.publish import Published

from .test_upkeep import TERMS, made, plain, results

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("small", [0, 9, 10_000])
def test_all_sizes_of_groups_give_the_same(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(upkeep, "SMALL", small)
    monkeypatch.setattr(upkeep, "AT_ONCE", 7)
    terms = made(random.Random(5))
    store = Published(spark, f"file://{tmp_path}/kept")
    upkeep.create(store, spark.createDataFrame(terms, TERMS))
    assert results(store) == plain(terms) and store.read("results").count() == len(plain(terms))


def test_long_chains_are_not_a_table_a_level(spark, tmp_path, monkeypatch):
    tables = []
    write = upkeep.written
    monkeypatch.setattr(upkeep, "written", lambda *a: tables.append(a[1]) or write(*a))
    terms = [("p", g, f"n{i}", f"n{i - 1}" if i else None, 1.0 + (i == 3)) for g in "ab" for i in range(30)]
    store = Published(spark, f"file://{tmp_path}/kept")
    upkeep.create(store, spark.createDataFrame(terms, TERMS))
    assert {v for (_, n), (v, _) in results(store).items() if n == "n29"} == {2.0}
    assert len(tables) <= 2


def test_terms_are_met_once(spark, monkeypatch):
    """Of what a round met, later rounds have no term again."""
    met = []
    write = upkeep.written
    monkeypatch.setattr(upkeep, "written", lambda df, tag: met.append(write(df, tag)) or met[-1] if tag == "met" else write(df, tag))
    terms = [("p", "g", f"n{i}", f"n{i - 1}" if i else None, 2.0) for i in range(4)]
    got = {r["name"]: r["value"] for r in upkeep.evaluate(spark.createDataFrame(terms, TERMS)).collect()}
    assert got == {"n0": 2.0, "n1": 4.0, "n2": 8.0, "n3": 16.0} and [m.count() for m in met] == [3, 2, 1]


def test_null_coefficients_and_groups_in_two_parts(spark, tmp_path):
    """Null coefficients count for nothing; a group in two parts has its results in both, as its terms are read together."""
    rows = [("p", "g", "a", None, None), ("p", "g", "b", "a", 1.0), ("p", "g", "c", None, 3.0), ("p", "g", "c", "d", None), ("p", "g", "d", None, float("inf")), ("q", "h", "x", None, 2.0), ("r", "h", "y", "x", 5.0)]
    store = Published(spark, f"file://{tmp_path}/kept")
    upkeep.create(store, spark.createDataFrame(rows, TERMS))
    got = sorted((r["part"], r["group"], r["name"], r["value"], r["problem"]) for r in store.read("results").collect())
    assert got == [
        ("p", "g", "a", None, None), ("p", "g", "b", None, upkeep.CIRCULAR), ("p", "g", "c", 3.0, None), ("p", "g", "d", float("inf"), None),
        ("q", "h", "x", 2.0, None), ("q", "h", "y", 10.0, None), ("r", "h", "x", 2.0, None), ("r", "h", "y", 10.0, None),
    ]


def test_levels_of_nothing():
    t = pa.table({c: pa.array([], pa.float64() if c == "coef" else pa.string()) for c in ("group", "name", "reads", "coef")})
    assert upkeep.levels(t).num_rows == 0


def test_lines_of_an_order_are_read_once(spark):
    plan = keeping.order_terms(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey") and plan.count("Relation") == 2
    assert keeping.order_terms(spark, SF).where(F.col("name") == "bonus").count() == 2 * spark.read.parquet(f"{SF}/lineitem.parquet").join(spark.read.parquet(f"{SF}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey").distinct().count()
