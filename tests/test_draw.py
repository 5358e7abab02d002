"""Draws over tables, the way from entity files to flags, and documents that are read once."""

from __future__ import annotations

import random

import pytest

from lexaudit.operators import checks, sampling
from lexaudit.plans import checking, pieces


@pytest.mark.parametrize("seed", range(3))
def test_draw_by_quota_is_that_of_all_candidates(spark, seed):
    """Few abilities and texts with very many rows, shared by rules, so that what is used up matters."""
    r = random.Random(seed)
    rows = [{"rule": r.choice("abc"), "id": f"i{i}", "ability": f"a{r.choice([0, 0, 0, *range(12)])}", "text": f"t{r.choice([0, 0, *range(9)])}"} for i in range(900)]
    df = spark.createDataFrame([(x["rule"], x["id"], x["ability"], x["text"]) for x in rows], "rule string, id string, ability string, text string")
    for share in (None, 0.3):
        want, moved = sampling.quota_draw(rows, ["a", "b", "c"], 7, seed=seed, max_share=share)
        got, told = sampling.draw_by_quota(df, 7, seed=seed, max_share=share)
        assert {x["id"] for x in got.collect()} == {x["id"] for x in want} and told == moved


@pytest.mark.parametrize("name", ["quota_of_orders", "quota_of_nations"])
def test_draws(agree, name):
    agree(pieces.QUERIES[name], pieces.SQL[name])


def test_from_entity_files_to_flags(agree):
    agree(checking.entity_flags, checking.ENTITY_FLAGS)


def test_documents_are_read_once(spark):
    """The rules read a table of facts by kind; no plan over it reads documents again, or joins an input with itself on its id alone."""
    flags = checks.check_inputs(checking.inputs(spark, "/root/testdata/sf0.001"))
    plan = flags._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "what=" not in plan and "PartitionFilters: [isnotnull(what" in plan
