"""Steps that must not depend on how small a table is in its files."""

import json

from lexaudit.operators import checks, expr, setops
from lexaudit.sources.publish import Published
from lexaudit.sources.shared import written


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_tables_are_joined_by_shuffle(spark):
    one = written(spark.range(1000), "one")
    joined = one.groupBy("id").count().join(written(spark.range(1000).where("id > 1"), "two").select("id"), "id", "left")
    assert "Broadcast" not in plan_of(joined) and joined.count() == 1000


def test_tokens_of_one_small_file_are_many_tasks(spark):
    rows = spark.createDataFrame([(i, json.dumps({"mSpell": {"DataValues": [{"name": "A", "values": [i % 3]}]}}), t) for i in range(60) for t in ("A", "B", None)], "id long, spell string, token string").coalesce(1)
    found = expr.resolve_tokens(rows)
    assert found.rdd.getNumPartitions() >= 4
    got = {(r.id, r.token): (r.status, r.base) for r in found.collect()}
    assert got == {(i, t): s for i in range(60) for t, s in (("A", ("resolved", [float(i % 3)])), ("B", ("unresolved", None)), (None, ("ignored", None)))}


def test_equal_documents_have_equal_facts(spark):
    docs = [json.dumps({"spell": {"spell": "S", "data_values": {"A": [i]}}}) for i in range(3)]
    rows = [(str(i), d) for i, d in enumerate([docs[0], None, docs[1], "{", docs[0], docs[2], docs[0], "[]"][:7])]
    f = checks.facts(spark.createDataFrame(rows, "id string, input string").coalesce(1))
    got = {(r.id, r.what, r.name, r.number, tuple(r.ranks or ())) for r in f.collect()}
    want = {(str(i), w, n, x, k) for i, v in ((0, 0.0), (2, 1.0), (4, 0.0), (5, 2.0), (6, 0.0)) for w, n, x, k in (("data_value", "A", None, (v,)), ("number", None, v, ()))}
    assert got == want


def test_changed_rows_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(setops, "TASK_ROWS", 10)
    asked = []
    own = setops.settings
    monkeypatch.setattr(setops, "settings", lambda s, values: asked.append(int(values["spark.sql.shuffle.partitions"])) or own(s, values))
    a = spark.createDataFrame([(1, None)] * 3 + [(2, "x")] * 2 + [(None, "y")] + [(i, "z") for i in range(100, 300)], "k long, s string")
    b = spark.createDataFrame([(1, None)] + [(2, "x")] * 4 + [(None, "y")] + [(i, "z") for i in range(101, 300)], "k long, s string")
    got = sorted((r.k, str(r.s), r.change) for r in setops.changed_paths(a, b, ["k", "s"]).collect())
    assert got == [(1, "None", "removed")] * 2 + [(2, "x", "added")] * 2 + [(100, "z", "removed")]
    assert asked and asked[0] >= 41


def test_parts_are_not_cut_into_a_file_for_each_task(spark, tmp_path):
    store = Published(spark, f"file://{tmp_path}/store")
    rows = spark.range(4000).repartition(8).selectExpr("id", "concat('p', id % 10) AS part")
    store.publish({"t": rows}, part="part")
    assert len(list(tmp_path.glob("store/data/*/*/*.parquet"))) == 10
    assert store.read("t").orderBy("id").collect() == rows.orderBy("id").collect()
