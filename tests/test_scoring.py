"""Evaluation, injection, grouping, sampling and resumed streams."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexaudit.operators import evaluate, graph, inject, joins, sampling, setops, windows
from lexaudit.streaming import resume


def test_judging(spark):
    cases = spark.createDataFrame([("p-1", "1:en:a:s:t", "planted", "g1", "A1"), ("p-2", "1:en:b:s:t", "planted", "g2", "A2"), ("r-1", "1:en:c:s:t", "real", "g1", "A3")], "id string, record_id string, set string, `group` string, answer string")
    flag = lambda *n: [{"names": x, "reason": ""} for x in n]
    rows = [
        ("m", 1, 0, "p-1", None, flag("@X@"), False), ("m", 1, 1, "p-2", None, flag(), True), ("m", 1, 2, "p-2", None, flag("@Y@"), False), ("m", 1, 3, "1:en:c:s:t", None, flag("@Z@"), False),
        ("m", 2, 0, "p-1", None, flag("@X@"), False), ("m", 2, 1, "p-2", None, flag("@no@"), False), ("m", 3, 0, "p-1", None, flag("@no@"), False), ("s", 1, 0, "1:en:b:s:t", "p-2", flag("@Y@"), False),
    ]
    lines = spark.createDataFrame(rows, "method string, run int, pos long, id string, planted_id string, flags array<struct<names:string,reason:string>>, failed boolean")
    flags = evaluate.reduced_flags(lines)
    assert flags.count() == 7
    jobs = evaluate.with_key(evaluate.on_cases(cases, flags), "catch", "answer", "case_record", "text_field", "names")
    none = spark.createDataFrame([], "key string, catch boolean")
    assert evaluate.to_do(jobs, none).count() == 5
    judge = lambda p: ~p["names"].str.contains("no")
    cache = evaluate.fill_cache(jobs, none, judge, "catch", "boolean")
    kept = spark.createDataFrame(cache.collect(), cache.schema)
    assert kept.count() == 5 and evaluate.to_do(jobs, kept).count() == 0
    got = {(r.case_id, r.method): (r.votes, r.runs, r.caught) for r in evaluate.judged(cases, flags, lines, kept).collect()}
    assert got[("p-1", "m")] == (2, 3, True) and got[("p-2", "m")] == (1, 3, False) and got[("r-1", "m")] == (1, 3, False) and got[("p-2", "s")] == (1, 1, True) and got[("p-1", "s")] == (0, 1, False)
    rep = evaluate.report(evaluate.judged(cases, flags, lines, kept), {"m vs s": ("m", "s")})
    t = rep["tests"].first()
    assert (t.both, t.only_a, t.only_b, t.neither, t.p, t.significant) == (0, 1, 1, 0, 1.0, False)
    r = {(x.method, x.group): (x.k, x.n) for x in rep["planted_recall"].collect()}
    assert r[("m", None)] == (1, 2) and r[("m", "g1")] == (1, 1) and rep["real_recall"].count() == 4
    assert "m " in evaluate.as_text(rep["planted_recall"])
    f = {(x.method, x.run): (x.records, x.failed, x.warn) for x in evaluate.failed_calls(lines).collect()}
    assert f[("m", 1)] == (3, 0, False)
    sample = evaluate.sweep_sample(flags, 2, 7)
    assert {x.method: x["count"] for x in sample.groupBy("method").count().collect()} == {"m": 2, "s": 1}
    labels = sample.select("key", F.when(F.col("method") == "s", "cant_tell").otherwise("real_mismatch").alias("label"))
    fa = {x.method: x for x in evaluate.false_alarms(sample, labels, flags, 100).collect()}
    assert fa["m"].precision == 1.0 and fa["m"].flags_per_1000 == 30.0 and fa["s"].precision_sure is None


def test_calls():
    calls = []

    def call(r):
        calls.append(r["id"])
        if r["id"] == "bad":
            return {"flags": "x", "prompt_tokens": 5}
        if r["id"] == "stop":
            raise evaluate.StopRun("402")
        if r["id"] == "late" and len([c for c in calls if c == "late"]) < 2:
            raise RuntimeError("net")
        return {"flags": [], "prompt_tokens": 5, "completion_tokens": 1}

    assert evaluate.call_with_retries(call, {"id": "a"}) == {"id": "a", "flags": [], "failed": False, "attempts": 1, "prompt_tokens": 5, "completion_tokens": 1}
    assert evaluate.call_with_retries(call, {"id": "late"})["attempts"] == 2
    bad = evaluate.call_with_retries(call, {"id": "bad"})
    assert bad["failed"] and bad["attempts"] == 4 and bad["prompt_tokens"] == 20
    with pytest.raises(evaluate.StopRun):
        evaluate.call_with_retries(call, {"id": "stop"})


def test_run_checker(spark):
    recs = spark.createDataFrame([("a", "{}"), ("b", "{}"), ("c", "{}")], "id string, input string")
    done = spark.createDataFrame([("a", False), ("b", True)], "id string, failed boolean")
    got = evaluate.run_checker(recs, done, lambda r: {"flags": [{"names": r["id"], "reason": ""}], "cost": 0.5}).collect()
    assert sorted(r.id for r in got) == ["b", "c"] and all(r.cost == 0.5 and not r.failed for r in got)
    assert evaluate.settings_grid([{"t": 1}, {"t": 2}], recs).count() == 6


def test_spot_check(spark):
    items = spark.createDataFrame([("catch", f"k{i}", "true") for i in range(9)] + [("label", "x", "cant_tell")], "check string, key string, verdict string")
    drawn = evaluate.spot_check(items, 3, 7)
    assert drawn.count() == 4
    filled = drawn.withColumn("author", F.when(F.col("check") == "label", " Cant_Tell ").when(F.col("key") == drawn.where("check = 'catch'").first().key, "").otherwise("no"))
    assert {r.check: (r.agree, r.n) for r in evaluate.spot_score(items, filled).collect()} == {"catch": (0, 2), "label": (1, 1)}


def test_injection(spark):
    s = spark.createDataFrame([(1, [40.0, 60.0]), (2, [0.3, 0.37])], "id int, v array<double>")
    got = {(r.id, r.factor): r.new_values for r in inject.scaled_plans(s, "v", inject.BASE_FACTORS).collect()}
    assert got[(1, 0.75)] == [30.0, 45.0] and (1, 0.8) not in got and (2, 1.25) not in got
    assert sorted(r.new_value for r in inject.ratio_plans(spark.createDataFrame([(1, 0.5)], "id int, c double"), "c").collect()) == [0.25, 0.75, 1.0]
    m = sorted((r.id, r.new_value) for r in inject.multiplier_plans(spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 1.5), (4, 2.0)], "id int, m double"), "m").collect())
    assert m == [(1, 2.0), (1, 4.0), (3, 0.75), (3, 2.25), (3, 3.0), (4, 3.0)]
    d = inject.drop_plans(spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"])], "id int, p array<string>"), "p")
    assert [r.new_parts for r in d.orderBy("dropped").collect()] == [["b", "c"], ["a", "c"], ["a", "b"]]
    sites = spark.createDataFrame([("r", "TotalDamage", 10.0)], "record string, name string, shown double")
    cands = spark.createDataFrame([("r", "BaseDamage", 20.0), ("r", "Slow", 20.0), ("r", "MaxDamage", 100.0), ("r", "totaldamage", 5.0)], "record string, other string, other_shown double")
    from lexaudit.functions.text import related

    assert [r.other for r in inject.other_value_plans(sites, cands, lambda a, b: related(a, b, ["total"])).collect()] == ["BaseDamage"]
    a = inject.anchors(spark.createDataFrame([(1, 0.5), (2, 7.0)], "id int, v double"), spark.createDataFrame([(1, 0.5000001, "coef"), (2, 7.1, "x")], "id int, o double, `where` string"), "id", "v", "o", "ratio")
    assert [tuple(r) for r in a.collect()] == [(1, "ratio", "coef")]
    doc = json.dumps({"a": [{"x": 1}, 2], "b": 3})
    rows = spark.createDataFrame([(1, doc, '["a",0,"x"]', "9"), (2, doc, '["a",1]', None)], "id int, doc string, path string, value string")
    got = {r.id: json.loads(r.changed) for r in inject.apply_changes(rows).collect()}
    assert got == {1: {"a": [{"x": 9}, 2], "b": 3}, 2: {"a": [{"x": 1}], "b": 3}}
    assert len(list(inject.paths_of(json.loads(doc)))) == 6


def test_self_check(spark):
    good = dict(resolved=True, text="t", planned_text="t", input="i2", original="i1", id_same=True, shape="s", planned_shape="s", data_same=False, is_text=False, others_same=True, level_up_same=True, shown="2", shown_before="1", base=[2.0], base_before=[1.0], dropped=False, has_scalings=False, anchored=True)
    bad = [{"resolved": False}, {"text": "x"}, {"input": "i1"}, {"shape": "q"}, {"is_text": True}, {"others_same": False}, {"level_up_same": False}, {"shown": "1"}, {"base": [-1.0]}, {"dropped": True, "base": [0.0]}, {"anchored": None}]
    df = spark.createDataFrame(pd.DataFrame([good, *(good | b for b in bad)]).astype(object), ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'array<double>' if isinstance(v, list) else 'string'}" for k, v in good.items()))
    assert [r.problem for r in inject.self_check(df).collect()] == [None, *inject.CHECKS]
    with pytest.raises(ValueError):
        inject.first_failure({"other": F.lit(True)})


def test_answers_and_verification(spark):
    df = spark.createDataFrame([(r, "X", "1", "2", "the row") for r in inject.RULES], "rule string, n string, b string, a string, w string")
    said = [r.s for r in df.select(inject.answer(F.col("rule"), F.col("n"), F.col("b"), F.col("a"), F.col("w")).alias("s")).collect()]
    assert all(s and s.endswith("; it disagrees with the row.") for s in said) and len(set(said)) == 5
    ids = inject.numbered_set(spark.createDataFrame([(c,) for c in "abc"], "record_id string"), "test", 1).collect()
    assert sorted(r.id for r in ids) == ["test-001", "test-002", "test-003"]


def test_quota_draw():
    cands = [{"rule": r, "id": f"{r}{i}", "ability": (r, i % n), "text": f"{r}{i}"} for r, n in (("a", 10), ("b", 2), ("c", 10)) for i in range(20)]
    drawn, moved = sampling.quota_draw(cands, ["a", "b", "c"], 12, seed=1)
    by = {r: sum(c["rule"] == r for c in drawn) for r in "abc"}
    assert by == {"a": 5, "b": 2, "c": 5} and moved[0]["from"] == "b" and moved[0]["count"] == 2 and len({c["ability"] for c in drawn}) == 12
    assert sampling.quota_draw(list(reversed(cands)), ["a", "b", "c"], 12, seed=1)[0] == drawn
    capped, _ = sampling.quota_draw(cands, ["a", "b", "c"], 30, seed=1, max_share=0.5, exclude=[("a", 0)])
    assert {r: sum(c["rule"] == r for c in capped) for r in "abc"} == {"a": 4, "b": 1, "c": 5} and ("a", 0) not in {c["ability"] for c in capped}


def test_groups(spark):
    names = ["ToraQ", "ToraW", "ToraWDetonate", "ToraWx", "ToraWBasicAttack", "Loose1", "Loose2", "Both", "ObjRoot", "ObjKid", "OdysseyW", "Alone", "Later"]
    rows = [("f", n, n, "obj" if n.startswith("Obj") else None, n in ("ToraQ", "ToraW")) for n in names]
    spells = spark.createDataFrame(rows, "folder string, path string, name string, object_group string, is_slot boolean")
    objs = {"Loose1": {"a": ["toraq"]}, "Loose2": {"b": "Loose1", "mAlternateName": "ToraW"}, "Both": {"x": "ToraQ", "y": {"z": "ToraW"}}, "OdysseyW": {"x": "ToraW"}}
    strings = graph.strings_of(spark.createDataFrame([("f", k, json.dumps(v)) for k, v in objs.items()], "folder string, path string, obj string"))
    edges = graph.links(strings, spells.select("folder", "name", "path"))
    later = spark.createDataFrame([("f", "Later", "ToraQ", "12.1"), ("f", "ToraWDetonate", "ToraQ", "12.1")], "folder string, name string, root string, `where` string")
    got = {r.path: (r.group, r.joined_by) for r in graph.assign_groups(spells, edges, later).collect()}
    assert got["ToraWDetonate"] == ("script name ToraW", "script-name prefix") and got["ToraWBasicAttack"][1] == "script-name prefix" and "ToraWx" not in got
    assert got["Loose1"] == got["Loose2"] == ("script name ToraQ", graph.LINKED) and got["ObjKid"] == ("obj", "AbilityObject") and got["Later"] == ("script name ToraQ", "AbilityObject in 12.1")
    assert not {"Both", "OdysseyW", "Alone"} & set(got)


def test_graph_edges(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "x"), (None, "a")], "a string, b string")
    assert dict(graph.connected_components(e, "a", "b").collect()) == {"a": "a", "b": "a", "c": "a", "x": "x"}
    got = {(r.source, r.target): r.steps for r in graph.reachable(e.where("a <> b"), "a", "b").collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("a", "a"): 3, ("b", "c"): 1, ("b", "a"): 2, ("b", "b"): 3, ("c", "a"): 1, ("c", "b"): 2, ("c", "c"): 3}
    comps = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2), ("e", 2)], "node string, component int")
    groups = spark.createDataFrame([("b", "g"), ("c", "g"), ("d", "h")], "node string, `group` string")
    assert [tuple(r) for r in graph.single_group(comps, groups).collect()] == [("a", "g")]


def test_joins_and_windows(spark):
    docs = spark.createDataFrame([(1, "Blue Fish swims, blue!"), (2, None)], "id int, t string")
    names = spark.createDataFrame([("blue",), ("blue fish",), ("fish swims",)], "name string")
    assert sorted(tuple(r) for r in joins.find_names(docs, "id", "t", names, 2).collect()) == [(1, 0, "blue fish"), (1, 3, "blue")]
    n = windows.numbered(spark.range(100).select((F.col("id") * 37 % 100).alias("v")), [F.col("v")], "n", 7)
    assert all(r.n == r.v + 1 for r in n.collect()) and windows.numbered(spark.range(0), [F.col("id")], "n").count() == 0
    v = spark.createDataFrame([("10.10",), ("10.9",), ("10.9b",), ("x",)], "v string")
    assert [r.v for r in v.orderBy(windows.version_key(F.col("v")).asc_nulls_last()).collect()] == ["10.9", "10.9b", "10.10", "x"]
    u = setops.union_all(docs, spark.createDataFrame([(3,)], "id int"))
    assert u.count() == 3 and spark.range(1).select(setops.same_set(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(1), F.lit(1))).alias("x")).first().x
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert {r.k: r.v for r in joins.upsert(old, spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int"), "k").collect()} == {"b": 3, "c": 4}


def test_resumed_stream(spark, tmp_path):
    judged = []

    def judge(df):
        judged.extend(r.key for r in df.collect())
        return df.select("key", F.lit(1).alias("verdict"))

    def start(n):
        stream = resume.lines_stream(spark, str(tmp_path / "log"), "key string, pos int")
        resume.fill_keyed_cache(stream, str(tmp_path / "cache"), str(tmp_path / f"check{n}"), judge)

    log = lambda *rows: spark.createDataFrame(rows, "key string, pos int").coalesce(1).write.mode("append").json(str(tmp_path / "log"))
    log(("a", 1), ("a", 2), ("b", 3), (None, 4))
    start(0)
    start(0)
    log(("b", 5), ("c", 6))
    start(0)
    start(1)  # a lost checkpoint reads all again and adds nothing
    assert sorted(judged) == ["a", "b", "c"] and spark.read.parquet(str(tmp_path / "cache")).count() == 3
    stream = resume.lines_stream(spark, str(tmp_path / "log"), "key string, pos int")
    resume.append_once(stream, str(tmp_path / "copy"), str(tmp_path / "check-copy"))
    assert {r.key: r.pos for r in resume.current(spark.read.parquet(str(tmp_path / "copy")).where("key IS NOT NULL"), "key", ["pos"]).collect()} == {"a": 2, "b": 5, "c": 6}


def test_nearest_literals(spark):
    df = spark.createDataFrame([(v,) for v in (None, 0, 1, 2, 3, 4, 5, 6)], "v int")
    near = lambda **k: [r.x for r in df.select(joins.in_list(F.col("v"), [5, 1, 3], **k).alias("x")).collect()]
    assert near(successor=True) == [None, 1, 1, 3, 3, 5, 5, None] and near(successor=False) == [None, None, 1, 1, 3, 3, 5, 5]
    assert near(successor=True, strict=True) == [None, 1, 3, 3, 5, 5, None, None] and near(successor=False, strict=True) == [None, None, None, 1, 1, 3, 3, 5]
    assert [r.x for r in df.select(joins.in_list(F.col("v"), [], True).alias("x")).collect()] == [None] * 8
