"""Key paths of JSON documents, and differences with renames."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexaudit.operators import graph, paths
from lexaudit.plans import matching, scoring
from lexaudit.sources import pages


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, doc string")


def test_nodes(spark):
    got = paths.nodes(docs(spark, '{"a/b":[1,{"c~":"x"}],"d[":{},"e":null,"f":1.50}', "{bad", None, "[]", "3", "[[],[[2]]]"), ["id"], "doc")
    rows = {(r["id"], r["path"], tuple(r["up"]), r["leaf"], r["json"]) for r in got.collect()}
    assert rows == {
        (0, "/a~1b", (), False, '[1,{"c~":"x"}]'),
        (0, "/a~1b[0]", ("/a~1b",), True, "1"),
        (0, "/a~1b[1]", ("/a~1b",), False, '{"c~":"x"}'),
        (0, "/a~1b[1]/c~0", ("/a~1b", "/a~1b[1]"), True, '"x"'),
        (0, "/d~2", (), True, "{}"),
        (0, "/e", (), True, "null"),
        (0, "/f", (), True, "1.5"),
        (5, "[0]", (), True, "[]"),
        (5, "[1]", (), False, "[[2]]"),
        (5, "[1][0]", ("[1]",), False, "[2]"),
        (5, "[1][0][0]", ("[1]", "[1][0]"), True, "2"),
    }
    assert paths.nodes(docs(spark).limit(0), ["id"], "doc").isEmpty()


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ('{"x":1,"y":2}', '{"y":2,"x":1}', set()),
        ('{"x":1,"y":2}', '{"z":1,"y":3}', {("renamed", "/x", "/z"), ("changed", "/y", None)}),
        ('{"x":{"p":[1,2],"q":5}}', '{"w":{"p":[1,2],"q":5}}', {("renamed", "/x", "/w")}),
        ('{"x":{"p":1,"q":5}}', '{"w":{"p":1,"q":6}}', {("renamed", "/x/p", "/w/p"), ("removed", "/x/q", None), ("added", "/w/q", None)}),
        ('{"x":7,"y":7}', '{"w":7}', {("removed", "/x", None), ("removed", "/y", None), ("added", "/w", None)}),  # not mutual
        ('{"x":[1,2,3]}', '{"x":[1,2]}', {("removed", "/x[2]", None)}),
        ('{"x":[{"a":1}]}', '{"x":[{"b":1}]}', {("renamed", "/x[0]/a", "/x[0]/b")}),
        ('{"x":1}', '{"x":{"y":2}}', {("changed", "/x", None), ("added", "/x/y", None)}),
        ('{"x":{"p":1}}', '{"x":{},"y":{"p":1}}', {("changed", "/x", None), ("renamed", "/x/p", "/y/p")}),
        ("null", '{"x":1}', {("added", "/x", None)}),
    ],
)
def test_differences(spark, a, b, want):
    got = paths.differences(docs(spark, a), docs(spark, b), ["id"], "doc")
    assert {(r["change"], r["path"], r["other"]) for r in got.collect()} == want


def test_equal_documents_are_not_unfolded(spark, monkeypatch):
    """Documents with one text on both sides have no difference and are left out first; repeated and null keys are as they were."""
    schema = "id int, doc string"
    a = spark.createDataFrame([(1, '{"x":1}'), (2, '{"x":1}'), (3, None), (4, '{"x":1}'), (5, '{"x":1}'), (5, '{"y":2}'), (None, '{"n":1}'), (6, '{"x":1}')], schema)
    b = spark.createDataFrame([(1, '{"x":1}'), (2, '{"x":2}'), (3, None), (4, '{ "x":1}'), (5, '{"x":1}'), (None, '{"n":1}'), (7, '{"x":1}')], schema)
    unfolded, own = [], paths.nodes
    monkeypatch.setattr(paths, "nodes", lambda df, *x: unfolded.extend(r[0] for r in df.select("id").collect()) or own(df, *x))
    got = sorted(((r["id"], r["change"], r["path"], r["other"]) for r in paths.differences(a, b, ["id"], "doc").collect()), key=str)
    want = [(2, "changed", "/x", None), (5, "removed", "/y", None), (None, "added", "/n", None), (None, "removed", "/n", None), (6, "removed", "/x", None), (7, "added", "/x", None)]
    assert got == sorted(want, key=str)
    assert sorted(unfolded, key=str) == sorted([2, 2, 4, 4, 5, 5, 5, None, None, 6, 7], key=str)


def test_strings_are_found_without_python(spark):
    objects = docs(spark, '{"a":["x",{"mScriptName":"own","n":"y\\"é"}],"mLocKeys":{"k":"z"},"n":"12","m":12,"e":"x"}').select(F.lit("f").alias("folder"), F.lit("p").alias("path"), F.col("doc").alias("obj"))
    found = graph.strings_of(objects)
    assert {r["value"] for r in found.collect()} == {"x", 'y"é', "12"}
    assert "Python" not in found._jdf.queryExecution().toString() and "Pandas" not in found._jdf.queryExecution().toString()


def test_lines_without_python_agree_with_a_parser(spark):
    """Nested, unclosed and quoted elements, references, raw text, odd tags: the parser of one page gives the same lines."""
    made = [
        "<h2>A</h2><p>one</p><h3>B</h3><ul><li>two <b>x</b></li><li>three</ul><h2>C</h2><blockquote><p>four</blockquote><script>no</script><p>five<br>six",
        "<p title='a > b'>x &amp;lt; y &lt;z&gt; &#65;&#x1F600; &nope; &</p> lost <td>1<td>2</table>tail<p>in <!-- <p>not --> p",
        "<h2></h2><h3>S</h3><p>a</p><h2>T</h2><p>b</p><h4>U</h4><h3>V</h3><p>c<h4>W</h4><p>d",
        "<li>out <p>inner</p> more</li><li>next",
        "<blockquote>q <p>p</p> r <blockquote>deep</blockquote> s</blockquote> none </blockquote><p>z",
        "<style>p{}</style><P CLASS=x>Upper</P><p></p><p> \u00a0 </p><p>a\tb\n c",
        "", None, "no tags", "<p", "<p>1 < 2</p>", "<script>never <p>ends",
    ]
    made = [m and m.encode().decode("unicode_escape") if m and "\\u" in m else m for m in made]
    got = pages.page_lines(spark.createDataFrame(list(enumerate(made)), "page_id int, html string"))
    rows = sorted((r["page_id"], r["section"], r["subject"], r["ability"], r["text"], r["tag"], r["quote"]) for r in got.collect())
    want = sorted((i, x["section"], x["subject"], x["ability"], x["text"], x["tag"], x["quote"]) for i, m in enumerate(made) for x in pages.lines_of(m))
    assert rows == want
    assert "Python" not in got._jdf.queryExecution().toString() and "Pandas" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", matching.QUERIES)
def test_queries(agree, name):
    agree(matching.QUERIES[name], matching.SQL[name])


def test_lines_of_the_pages(agree):
    agree(scoring.html_lines_with_context, matching.SQL["html_lines_with_context"])
