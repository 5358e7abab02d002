"""Directory listings and summaries as tables: versions, languages, entities, and where a text table lies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaudit.operators.versions import number_of

# Entity ids above this are variants, layouts of text tables by name, and the first version of each.
MOST_ID = 10_000
LAYOUTS = (
    ("lol", "game/{loc}/data/menu/en_us/lol.stringtable.json"),
    ("main", "game/{loc}/data/menu/en_us/main.stringtable.json"),
    ("main_locale", "game/data/menu/main_{loc}.stringtable.json"),
    ("fontconfig_json", "game/data/menu/fontconfig_{loc}.txt.json"),
    ("fontconfig", "game/data/menu/fontconfig_{loc}.txt"),
)
LAYOUT_STARTS = (("14.15", "lol"), ("14.4", "main"), ("12.23", "main_locale"), ("11.1", "fontconfig_json"), ("0.0", "fontconfig"))


def folders(listing: DataFrame, name: str = "name") -> DataFrame:
    """Distinct ``major.minor`` folders of a listing, in order of version."""
    v = F.regexp_replace(name, "/$", "")
    return listing.select(v.alias("folder")).where(F.col("folder").rlike(r"^\d+\.\d+$")).distinct().orderBy(number_of(F.col("folder")))


def latest(listing: DataFrame, name: str = "name") -> DataFrame:
    """The folder with the largest version."""
    return folders(listing, name).agg(F.max_by("folder", number_of(F.col("folder"))).alias("folder"))


def locales(paths: DataFrame, path: str = "path") -> DataFrame:
    """Distinct languages of the paths of text tables, in order."""
    found = F.coalesce(*(F.nullif(F.regexp_extract(path, p, 1), F.lit("")) for p in (r"fontconfig_([a-z]{2}_[a-z]{2})\.", r"main_([a-z]{2}_[a-z]{2})\.", r"game/([a-z]{2}_[a-z]{2})/data/menu/")))
    return paths.select(found.alias("locale")).where("locale IS NOT NULL").distinct().orderBy("locale")


def entities(summary: DataFrame) -> DataFrame:
    """(id, name, folder) of a summary(id, name, alias) without placeholders and variants."""
    return summary.where(F.col("id").between(1, MOST_ID - 1)).select("id", "name", F.lower("alias").alias("folder"))


def layout_order(version: str) -> list[tuple[str, str]]:
    """Layouts to look for, the one that a version is expected to have first."""
    key = tuple(map(int, version.split(".")))
    first = next(name for start, name in LAYOUT_STARTS if key >= tuple(map(int, start.split("."))))
    return sorted(LAYOUTS, key=lambda x: x[0] != first)


def find_table(paths: Sequence[str], version: str, locale: str, recorded: str | None = None) -> str | None:
    """The text table's path: the recorded one if it is there, else the first layout that is."""
    have = set(paths)
    tried = [recorded] * bool(recorded) + [p.format(loc=locale) for _, p in layout_order(version)]
    return next((p for p in tried if p in have), None)
