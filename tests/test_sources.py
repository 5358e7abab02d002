"""Sources and sinks, binary decoders, pages, versions and manifests."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from lexaudit.operators import manifest, versions
from lexaudit.sources import binary, files, pages


def test_json_lines_and_unwrapping(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id":"a","kind":"k","input":{"id":"in","text":"t"}}\n\n{"id":"b","input":{"id":"x","text":"u"}}\n')
    df = files.json_lines(spark, str(p), "id string, kind string, input struct<id string, text string>")
    assert df.count() == 2
    got = {json.loads(r.input).get("text"): r.item for r in files.unwrapped(df).collect()}
    assert json.loads(got["t"]) == {"id": "a", "kind": "k"} and got[None] is None
    assert {r.id: json.loads(r.input)["text"] for r in files.records(df).collect()} == {"a": "t", "b": "u"}
    with pytest.raises(FileNotFoundError, match="make it with: run"):
        files.record_pair(spark, str(tmp_path), "1.1", "en", "run")


def test_cases_runs_and_sinks(spark, tmp_path):
    c = tmp_path / "c.csv"
    c.write_text('unit_id,status,prefix_patch,locale,champion_folder,spell_path,text_field,mechanism,text_says,data_says,reason\nu1,confirmed,1.1,en,f,p,t,m,"a, b","c ""q""",r\nu2,open,1.1,en,f,p,t,m,a,b,c\n')
    rows = files.cases(spark, str(c)).collect()
    assert [(r.id, r.record_id, r.set, r.group) for r in rows] == [("u1", "1.1:en:f:p:t", "real", "m")] and 'c "q"' in rows[0].answer
    p = tmp_path / "p.jsonl"
    p.write_text('{"id":"s-001","record_id":"r","rule":"x","answer":"z"}\n')
    assert files.cases(spark, str(p)).first().group == "x"
    assert files.method_spec("m=a,b") == ("m", ["a", "b"])
    with pytest.raises(ValueError):
        files.method_spec("m")
    r = files.runs(spark, {"m": [str(p), str(p)]}, "id string")
    assert sorted((x.method, x.run, x.id) for x in r.collect()) == [("m", 1, "s-001"), ("m", 2, "s-001")]
    df = spark.createDataFrame([("a", None, 1), ("b", "é", 2)], "id string, v string, _hidden int")
    files.write_json_lines(df, str(tmp_path / "out"), one_file=True)
    text = "".join(x.read_text() for x in (tmp_path / "out").glob("*.json"))
    assert text == '{"id":"a"}\n{"id":"b","v":"é"}\n'
    files.append_log(df, str(tmp_path / "log"))
    files.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    files.write_csv(df, str(tmp_path / "csv"), ["v", "id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["v", "id"]
    m = json.loads(files.manifest(spark.createDataFrame([("s-2", "x"), ("s-1", "x")], "id string, rule string"), seed=7).first().manifest)
    assert m["seed"] == 7 and m["count"] == 2 and m["counts"] == {"x": 2} and [e["id"] for e in m["errors"]] == ["s-1", "s-2"]


def string_table(version, entries):
    bits, data, packed = binary.hash_bits(version), b"", []
    for key, text in entries:
        packed.append(len(data) << bits | binary.table_key(key, version))
        data += text + b"\0"
    head = b"RST" + bytes([version]) + (b"\x01\x02\0\0\0xx" if version == 2 else b"")
    return head + struct.pack(f"<I{len(packed)}Q", len(packed), *packed) + (b"\0" if version < 5 else b"") + data


@pytest.mark.parametrize("version", [2, 3, 4, 5])
def test_string_tables(spark, tmp_path, version):
    blob = string_table(version, [("Key_A", "Text é".encode()), ("key_b", b"\xff\x01secret"), ("key_c", b"")])
    got_version, texts = binary.read_string_table(blob)
    assert got_version == version and texts == {binary.table_key("key_a", version): "Text é", binary.table_key("key_c", version): ""}
    (tmp_path / "t.txt").write_bytes(blob)
    (tmp_path / "t.json").write_text(json.dumps({"version": version, "entries": {"Key_R": "readable", f"{{{binary.table_key('key_h', version):010x}}}": "hashed"}}))
    table = binary.text_table(spark, str(tmp_path))
    assert table.count() == 4
    keys = spark.createDataFrame([("KEY_A",), ("key_r",), ("key_H",), ("none",)], "loc_key string")
    found = {r.loc_key: (r.text, r.found_by_hash) for r in binary.with_text(keys, table, version=version).collect()}
    assert found == {"KEY_A": ("Text é", True), "key_r": ("readable", False), "key_H": ("hashed", True), "none": (None, False)}
    over = binary.overridden(table.select("key", "text"), spark.createDataFrame([("key_r", "new")], "key string, text string"))
    assert {r.text for r in over.collect()} == {"Text é", "", "new", "hashed"}
    with pytest.raises(ValueError):
        binary.read_string_table(b"XXX" + blob[3:])
    with pytest.raises(ValueError):
        binary.read_string_table(b"RST\x09")


def tree(old=False):
    kinds = binary.COMPOSITE_OLD if old else binary.COMPOSITE_NEW
    n = {v: k for k, v in reversed(list(kinds.items()))}
    h = lambda s: int(binary.fnv(s)[1:-1], 16)
    text = lambda s: struct.pack("<H", len(s.encode())) + s.encode()
    fields = [
        (h("Name"), 16, text("né")),
        (h("Num"), 10, struct.pack("<f", 0.5)),
        (h("Vec"), 11, struct.pack("<2f", 1, 2)),
        (h("Big"), 9, struct.pack("<Q", 2**63 + 1)),
        (h("Link"), n["link"], struct.pack("<I", h("Other/Path"))),
        (h("List"), n["list"], bytes([2]) + struct.pack("<II", 6, 2) + struct.pack("<2b", -1, 3)),
        (h("Opt"), n["option"], bytes([7, 1]) + struct.pack("<I", 9)),
        (h("Map"), n["map"], bytes([16, 2]) + struct.pack("<II", 4 + 3 + 1, 1) + text("k") + struct.pack("<b", 5)),
        (h("Flag"), n["flag"], b"\x01"),
        (h("Sub"), n["embed"], struct.pack("<I", h("SubClass")) + struct.pack("<I", 2 + 5 + 1) + struct.pack("<HIB", 1, h("X"), 3) + b"\x07"),
        (h("Null"), n["pointer"], struct.pack("<I", 0)),
    ]
    body = struct.pack("<I", h("Some/Path")) + struct.pack("<H", len(fields)) + b"".join(struct.pack("<IB", a, b) + c for a, b, c in fields)
    return b"PROP" + struct.pack("<I", 3) + struct.pack("<I", 1) + text("linked.bin") + struct.pack("<II", 1, h("SomeClass")) + struct.pack("<I", len(body)) + body


@pytest.mark.parametrize("old", [False, True])
def test_object_trees(spark, tmp_path, old):
    blob = tree(old)
    names = {binary.fnv(k): k for k in ("Name", "Num", "Vec", "Big", "Link", "List", "Opt", "Map", "Flag", "Sub", "Null", "X", "SubClass", "SomeClass", "Some/Path", "Other/Path")}
    got = binary.renamed(binary.read_object_tree(blob), names)
    assert got == {"Some/Path": {"Name": "né", "Num": 0.5, "Vec": [1.0, 2.0], "Big": 2**63 + 1, "Link": "Other/Path", "List": [-1, 3], "Opt": 9, "Map": {"k": 5}, "Flag": True, "Sub": {"X": 7, "__type": "SubClass"}, "Null": None, "__type": "SomeClass"}}
    for bad in (blob[:-1], blob + b"x", b"XROP" + blob[4:], b""):
        with pytest.raises(ValueError):
            binary.read_object_tree(bad)
    for folder, export, raw in (("aaa", {"Some/Path": {"x": 1}, "Other/Path": 2}, blob), ("bbb", {"P": {"__type": "T", "v": 1}}, None), ("ccc", {"P": 1}, None), ("jade_x", {"P": 1}, None)):
        d = tmp_path / folder
        d.mkdir()
        (d / f"{folder}.bin.json").write_text(json.dumps(export))
        if raw:
            (d / f"{folder}.bin").write_bytes(raw)
    rows = {r.folder: r for r in binary.object_folder(spark, str(tmp_path), ("Name", "SomeClass")).collect()}
    assert set(rows) == {"aaa", "bbb", "ccc"}
    assert rows["aaa"].source == "binary" and rows["aaa"].path == "Some/Path" and json.loads(rows["aaa"].obj)["Name"] == "né"
    assert rows["bbb"].source == "export" and rows["ccc"].problem


def test_pages(spark):
    html = "<h2>A</h2><p>one</p><h3>B</h3><ul><li>two <b>x</b></li><li>three</ul><h2>C</h2><blockquote><p>four</blockquote><script>no</script><p>five<br>six"
    lines = pages.lines_of(html)
    assert [(x["section"], x["subject"], x["text"], x["quote"]) for x in lines] == [("A", "", "one", False), ("A", "B", "two x", False), ("A", "B", "three", False), ("C", "", "four", True), ("C", "", "five six", False)]
    df = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert pages.page_lines(df).count() == 5
    page = '<script id="__NEXT_DATA__" type="x">{"a":{"body":"<p>hi</p>"}}</script>'
    assert pages.article_body(page) == "<p>hi</p>" and pages.article_body("x") is None
    assert spark.createDataFrame([(page,)], "h string").select(pages.embedded_json(F.col("h")).alias("j")).first().j == '{"a":{"body":"<p>hi</p>"}}'
    slugs = pages.candidate_slugs(spark, [2024, 2025], 9, ["notes-{yy}-{n}", "notes-{year}-{n}"])
    assert slugs.count() == 36
    known = spark.createDataFrame([("notes-24-1",), ("notes-2024-1",), ("notes-2024-3",), ("notes-24-9",)], "slug string")
    assert [(r.year, r.number, r.slug) for r in sorted(pages.discovered(slugs, known).collect())] == [(2024, 1, "notes-24-1"), (2024, 3, "notes-2024-3")]


def test_versions(spark):
    folders = ["10.16", "10.18", "13.1", "13.3", "15.24", "16.1", "14.24", "15.1", "latest"]
    df = spark.createDataFrame([("13.1B",), ("10.17",), ("26.1",), ("25.S1.1",), ("99.1",), ("10.1",), ("x",), ("2025.24",)], "name string")
    got = {r.name: (r.shipped, r.before, r.problem) for r in versions.map_notes(df, "name", folders).collect()}
    assert got["13.1B"][:2] == ("13.3", "13.1") and got["10.17"][:2] == ("10.18", "10.16") and got["26.1"][:2] == ("16.1", "15.24") and got["25.S1.1"][:2] == ("15.1", "14.24")
    assert got["99.1"][:2] == (None, "16.1") and got["99.1"][2] and got["10.1"][:2] == ("10.16", None) and "oldest" in got["10.1"][2] and got["x"][:2] == (None, None)
    assert got["2025.24"] == ("15.24", "15.1", None)
    starts = [("0.0", "oldest"), ("11.1", "b"), ("14.4", "c"), ("14.15", "d")]
    rows = spark.createDataFrame([("9.24",), ("11.1",), ("14.9",), ("14.15",)], "v string").select(versions.layout_of(F.col("v"), starts).alias("l")).collect()
    assert [r.l for r in rows] == ["oldest", "b", "c", "d"]
    seeds = spark.createDataFrame([("a", "10.9"), ("b", "10.9")], "key string, version string")
    table = spark.createDataFrame([("a", "10.2", "x"), ("a", "10.10", "y"), ("a", "11.1", "z")], "key string, version string, value string")
    assert {r.key: (r.found_version, r.found) for r in versions.first_later(seeds, table, "key", "version").collect()} == {"a": ("10.10", "y"), "b": (None, None)}
    assert versions.nearest_lists(["10.9"], ["10.2", "10.10", "9.24"]) == {"10.9": ("10.2", "10.10")}


def test_manifest(spark):
    def plan(*row):
        df = spark.createDataFrame([row], "refresh boolean, cache boolean, stored string, remote string")
        return df.select(manifest.plan(F.col("refresh"), F.col("cache"), F.col("stored"), F.col("remote")).alias("p")).first().p

    assert plan(True, True, None, "1") == "refresh" and plan(False, False, None, "1") == "first" and plan(False, True, "1", "1") == "recheck"
    assert plan(False, True, None, "1").startswith("mismatch") and plan(False, True, "2", "1").startswith("mismatch")
    schema = "path string, bytes long, last_modified string, downloaded_at string, status string"
    old = spark.createDataFrame([("a", 1, "x", "1", "downloaded"), ("b", 2, "x", "1", "cached"), ("c", 3, "x", "1", "downloaded")], schema)
    run = spark.createDataFrame([("a", 10, "y", "2", "downloaded"), ("b", 20, "y", "2", "cached"), ("d", 4, "y", "2", "cached")], schema)
    failed = spark.createDataFrame([("c",)], "path string")
    got = {r.path: (r.bytes, r.downloaded_at) for r in manifest.merge_files(old, run, failed, "recheck").collect()}
    assert got == {"a": (10, "2"), "b": (2, "1"), "d": (4, "2")}
    assert manifest.merge_files(old, run, failed, "refresh").count() == 3
    assert manifest.totals(run).first().total_bytes == 34
    facts = manifest.merged_facts(False, {"seconds": 5}, {"seconds": 6, "fetched_at": "t"}, 0, "recheck")
    assert facts["seconds"] is None and facts["last_checked"] == "t"
    assert manifest.merged_facts(None, None, {"seconds": 6}, 0, "first")["seconds"] == 6
    bodies = [("a/x.json", b"{}", None, None), ("a/x.json", b"{", None, "not valid JSON"), ("a/x.json", b"[]", None, "not an object"), ("a.bin", b"PROPx", None, None), ("a.bin", b"x", None, "not an object tree"), ("a.txt", b"RST1", None, None), ("a.txt", b"no", None, "not a string table"),
              ("m/champion-summary.json", b"{}", None, "not a list"), ("m/champion-summary.json", b"[]", None, None), ("s.stringtable.json", b'{"entries":{}}', None, None), ("s.stringtable.json", b'{"a":1}', None, "no entries object"), ("q.json", b"", None, "empty body"), ("q.json", b"{}", 3, "wrong size")]
    df = spark.createDataFrame([b[:3] for b in bodies], "path string, body binary, n int")
    assert [r.p for r in df.select(manifest.body_problem(F.col("path"), F.col("body"), F.col("n")).alias("p")).collect()] == [b[3] for b in bodies]
    ok = spark.createDataFrame([("1", "1")], "a string, b string")
    assert manifest.must_match(ok, "a", "b").count() == 1
    with pytest.raises(Exception, match="built from"):
        manifest.must_match(spark.createDataFrame([("1", "2")], "a string, b string"), "a", "b").collect()
