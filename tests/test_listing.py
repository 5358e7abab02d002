"""Listings."""

from lexaudit.sources import listing


def test_listing(spark):
    names = spark.createDataFrame([("10.9/",), ("10.10/",), ("latest/",), ("10.9",), ("9.24/",)], "name string")
    assert [r.folder for r in listing.folders(names).collect()] == ["9.24", "10.9", "10.10"] and listing.latest(names).first().folder == "10.10"
    paths = spark.createDataFrame([("game/data/menu/fontconfig_de_de.txt",), ("game/fr_fr/data/menu/en_us/lol.stringtable.json",), ("game/data/menu/main_ko_kr.stringtable.json",), ("x",)], "path string")
    assert [r.locale for r in listing.locales(paths).collect()] == ["de_de", "fr_fr", "ko_kr"]
    summary = spark.createDataFrame([(-1, "None", "None"), (1, "Ann", "Ann"), (60001, "X", "Jade_X")], "id int, name string, alias string")
    assert [tuple(r) for r in listing.entities(summary).collect()] == [(1, "Ann", "ann")]


def test_layouts():
    first = lambda v: listing.layout_order(v)[0][0]
    assert [first(v) for v in ("10.25", "11.1", "12.22", "12.23", "14.4", "14.14", "14.15", "16.1")] == ["fontconfig", "fontconfig_json", "fontconfig_json", "main_locale", "main", "main", "lol", "lol"]
    assert len(listing.layout_order("14.15")) == 5
    have = ["game/data/menu/fontconfig_de_de.txt", "game/de_de/data/menu/en_us/main.stringtable.json"]
    assert listing.find_table(have, "14.15", "de_de") == have[1] and listing.find_table(have, "10.1", "de_de") == have[0]
    assert listing.find_table(have, "10.1", "fr_fr") is None and listing.find_table(have, "10.1", "de_de", have[1]) == have[1]
