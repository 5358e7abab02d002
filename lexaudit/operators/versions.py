"""Versions: names as keys, the version that shipped a change and the one before it, ranges of layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: names of notes.
NOTES_NAME = r"(?i)^(\d{1,4})\.(?:S1\.)?(\d+)([A-Za-z])?$"


def number_of(version: Column) -> Column:
    """``major.minor`` as one number that sorts as versions do; null for anything else."""
    m = version.rlike(r"^\d+\.\d+$")
    return F.when(m, F.substring_index(version, ".", 1).cast("long") * 100_000 + F.substring_index(version, ".", -1).cast("long"))


def parse_notes_name(name: Column) -> Column:
    """{version, letter} of a notes name; years from 25 on count as majors less ten."""
    n = F.trim(name)
    major = F.regexp_extract(n, NOTES_NAME, 1).cast("int")
    major = F.when(major >= 2000, major % 100).otherwise(major)
    major = F.when(major >= 25, major - 10).otherwise(major)
    minor = F.regexp_extract(n, NOTES_NAME, 2).cast("int")
    return F.when(n.rlike(NOTES_NAME), F.struct(F.concat_ws(".", major.cast("string"), minor.cast("string")).alias("version"), F.upper(F.regexp_extract(n, NOTES_NAME, 3)).alias("letter")))


def map_notes(names: DataFrame, name: str, folders: Sequence[str]) -> DataFrame:
    """names with shipped, before and problem, by the sorted list of folders (a short list; others are ignored).

    A plain name ships in the first folder at or after it; a lettered one, or one that has no folder, in the
    first after it.  ``before`` is the folder before that one.
    """
    ordered = sorted((f for f in folders if f.replace(".", "", 1).isdigit() and f.count(".") == 1), key=lambda f: tuple(map(int, f.split("."))))
    known = F.array(*map(F.lit, ordered)).cast("array<string>")
    p = parse_notes_name(F.col(name))
    key = number_of(p["version"])
    strict = (p["letter"] != "") | ~F.array_contains(known, p["version"])
    later = F.filter(known, lambda f: F.when(strict, number_of(f) > key).otherwise(number_of(f) >= key))
    shipped = F.get(later, F.lit(0))
    at = F.array_position(known, shipped).cast("int")
    newest = F.lit(ordered[-1]) if ordered else F.lit(None).cast("string")
    before = F.when(shipped.isNull(), newest).when(at > 1, F.get(known, at - 2))
    problem = (
        F.when(p.isNull(), F.concat(F.lit("not a notes name: "), F.col(name)))
        .when(F.size(known) == 0, F.lit("no folder is known"))
        .when(shipped.isNull(), F.concat(F.lit("no folder yet for "), p["version"], p["letter"]))
        .when(at == 1, F.concat(shipped, F.lit(" is the oldest folder")))
    )
    ok = p.isNotNull() & (F.size(known) > 0)
    return names.select("*", F.when(ok, shipped).alias("shipped"), F.when(ok, before).alias("before"), problem.alias("problem"))


def layout_of(version: Column, starts: Sequence[tuple[str, str]]) -> Column:
    """The layout whose first version is the latest at or before a version."""
    ordered = sorted(starts, key=lambda s: tuple(map(int, s[0].split("."))))
    out = F.lit(None).cast("string")
    for first, layout in ordered:
        out = F.when(number_of(version) >= number_of(F.lit(first)), layout).otherwise(out)
    return out


def first_later(seeds: DataFrame, table: DataFrame, key: str, version: str) -> DataFrame:
    """seeds(key, version) with found_version and found: the first later row of table(key, version, value) for each."""
    s = seeds.select(key, version, number_of(F.col(version)).alias("_at"))
    t = table.select(F.col(key), F.col(version).alias("_v"), number_of(F.col(version)).alias("_n"), "value")
    j = s.join(t, key, "left").where("_n IS NULL OR _n > _at")
    best = j.groupBy(key, version).agg(F.min_by(F.struct(F.col("_v").alias("v"), F.col("value").alias("x")), "_n").alias("_b"))
    return seeds.join(best, [key, version], "left").select(*seeds.columns, F.col("_b.v").alias("found_version"), F.col("_b.x").alias("found"))


def nearest_lists(wanted: Sequence[str], available: Sequence[str]) -> dict[str, tuple[str | None, str | None]]:
    """For each version the nearest earlier and the nearest later one that has a list."""
    num = lambda v: tuple(map(int, v.split(".")))
    out = {}
    for w in wanted:
        before = [a for a in available if num(a) < num(w)]
        after = [a for a in available if num(a) > num(w)]
        out[w] = (max(before, key=num, default=None), min(after, key=num, default=None))
    return out
