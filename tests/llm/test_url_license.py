"""URL filter and license scan: DuckDB's rows, and edge cases."""

from lexaudit.llm import catalogue
from lexaudit.llm.license_scan import TEMPLATES, scan_licenses
from lexaudit.llm.url_filter import RULES, filter_urls, rules_frame


def test_queries_against_sql(agree):
    for name in ("op1_url_filter", "op10_license_scan"):
        agree(catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_url_edges(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Example.COM/en/77?x"), (5, "http://example.com/en/6"), (5, "http://example.com/en/6"), (6, "http://xexample.com/en/7"),
            (7, "x://a.net#y"), (8, "http://example.net/de/8"), (9, "http://a.org/es"), (10, "http://b.org/es/?q"), (11, "http://" + "a." * 500 + "org/es/" + "b" * 5000), (12, "a\nb://x.org/es/")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS _rid", "2 AS rule", "3 AS Host", "4 AS _k")
    got = filter_urls(df, rules_frame(spark, RULES))
    assert got.columns == ["page_id", "url", "_rid", "_k", "host", "path", "rule", "verdict"]
    by = {}
    for r in got.collect():
        by.setdefault(r.page_id, []).append((r.host, r.path, r.rule, r.verdict))
    assert by[1] == by[2] == by[3] == [("", "", None, "allow")]
    assert by[4] == [("a.example.com", "/en/77", "example.com/en/7", "allow")]
    assert by[5] == [("example.com", "/en/6", "com/en/", "block")] * 2
    assert by[6][0][2:] == ("com/en/", "block")
    assert by[7] == [("a.net", "", None, "allow")]
    assert by[8][0][2:] == ("example.net/de/8", "block")
    assert by[9][0][2:] == (None, "allow") and by[10][0][2:] == ("org/es/", "block") and by[11][0][2:] == ("org/es/", "block") and by[12][0][0] == "x.org"
    assert filter_urls(df.limit(0), rules_frame(spark, RULES)).count() == 0
    assert {r.verdict for r in filter_urls(df, rules_frame(spark, [])).collect()} == {"allow"}
    # the shuffled join of rule lists that are too long to broadcast
    same = filter_urls(df, rules_frame(spark, RULES), broadcast_rules=0)
    assert sorted(map(str, same.collect())) == sorted(map(str, got.collect()))


def test_license_edges(spark):
    long = ("word " * 5000) + "Licensed under the APACHE License, Version 2.0. " + ("other " * 5000)
    wrapped = TEMPLATES["mit"].replace(" ", "\n", 9).upper()
    rows = [(1, None), (2, ""), (3, "--"), (4, "under the MIT-license, Under the mit License"), (5, long), (6, wrapped), (6, wrapped), (7, "cc by nc cc by nc"), (8, "undér the mit license"), (None, "under the mit license")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS labels", "2 AS _norm", "3 AS _t")
    got = scan_licenses(df)
    assert got.columns[:3] == ["doc_id", "_norm", "_t"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score))
    assert by[1] == by[2] == by[3] == [(0, 0, None, None, "", "", 0.0)]
    assert by[4] == [(8, 2, 0, 4, "mit", "mit", 1.0)]
    assert by[5] == [(10008, 1, 5003, 5003, "apache-2", "apache-2", 1.0)]
    assert [x[4:6] for x in by[6]] == [("", "mit")] * 2 and by[6][0][6] == 1.0
    assert by[7] == [(6, 2, 0, 3, "cc-by-nc", "cc-by-nc", 1.0)]
    assert by[8][0][1] == 0 and by[None][0][1] == 1
    assert scan_licenses(df.limit(0)).count() == 0


def test_license_threshold(spark):
    words = TEMPLATES["bsd-3"].split()
    share = len(set(words))
    keep = sorted(set(words))[: -(-share * 8 // 10)]
    rows = [(1, " ".join(keep)), (2, " ".join(keep[:-1]))]
    got = {r.doc_id: r.labels for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "bsd-3", 2: ""}
