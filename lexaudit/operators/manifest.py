"""Fetch manifests: planning a run against what is stored, merging results, validating bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaudit.operators.joins import upsert

FIRST_FACTS = ("fetched_at", "seconds", "downloaded_bytes", "http_requests")


def plan(refresh: Column, has_cache: Column, stored: Column, remote: Column) -> Column:
    """first, recheck or refresh; or an error that starts with ``mismatch:`` where builds would mix."""
    return (
        F.when(refresh & has_cache, "refresh")
        .when(~has_cache, "first")
        .when(stored.isNull(), "mismatch: the stored build is not known")
        .when(stored != remote, F.concat(F.lit("mismatch: stored "), stored, F.lit(", served "), remote))
        .otherwise("recheck")
    )


def must_match(df: DataFrame, have: str, want: str) -> DataFrame:
    """df, whose evaluation fails at the first row where the two columns differ."""
    same = F.col(have).eqNullSafe(F.col(want))
    return df.where(F.when(same, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("built from "), F.coalesce(F.col(have), F.lit("nothing")), F.lit(", wanted "), F.coalesce(F.col(want), F.lit("nothing"))))))


def first_is_complete(old: DataFrame) -> DataFrame:
    """(patch, complete): whether an old manifest's first-download facts come from one whole run."""
    last_ok = F.col("last_run.mode").isNull() | F.col("last_run.mode").isin("first", "refresh")
    clean = (F.coalesce(F.size("failures"), F.lit(0)) <= 0) & (F.coalesce("downloaded_bytes", F.lit(0)) > 0)
    reused = F.exists(F.coalesce("files", F.array().cast(old.schema["files"].dataType)), lambda f: f["status"].eqNullSafe(F.lit("cached")))
    return old.select("patch", F.coalesce("first_download_complete", last_ok & clean & ~reused).alias("complete"))


def merge_files(old: DataFrame, run: DataFrame, failed: DataFrame, mode: str) -> DataFrame:
    """Files of the merged manifest: (path, bytes, last_modified, downloaded_at), one row each.

    A recheck keeps the old entry of a path unless it failed or was downloaded again; any other run starts
    from nothing.  old and run have a status that is dropped.
    """
    columns = ["path", "bytes", "last_modified", "downloaded_at"]
    if mode != "recheck":
        return run.select(*columns)
    o = old.select(*columns)
    # what was not downloaded again only fills gaps; the old entry of a failed path is gone before
    usable = o.join(failed.select("path").distinct(), "path", "left_anti")
    fresh = run.where("status = 'downloaded'").select(*columns)
    reused = run.where("status <> 'downloaded'").select(*columns).join(usable.select("path"), "path", "left_anti")
    return upsert(usable, fresh.unionByName(reused), "path", recheck=True).select(*columns)


def merged_facts(old_complete: bool | None, old: dict | None, run: dict, failures: int, mode: str) -> dict:
    """First-download facts of the merged manifest: kept only where they describe one whole download."""
    complete = bool(old_complete) if mode == "recheck" else failures == 0
    source = (old or {}) if mode == "recheck" else run
    return {k: source.get(k) if complete else None for k in FIRST_FACTS} | {"first_download_complete": complete, "last_checked": run.get("fetched_at"), "last_mode": mode}


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"))


def body_problem(path: Column, body: Column, expected: Column) -> Column:
    """Why a body (binary) is not what its path claims; null if it is.

    Empty and wrong-sized bodies, object trees without PROP or PTCH, string tables without RST, JSON that
    does not parse, tables without an ``entries`` object, lists that are none, and objects that are none.
    """
    text = F.decode(body, "UTF-8")
    parsed = F.try_parse_json(text)
    kind = F.schema_of_variant(parsed)
    head = F.decode(F.substring(body, 1, 4), "ISO-8859-1")
    is_json = path.endswith(".json")
    table = is_json & (F.contains(path, F.lit("stringtable")) | path.endswith(".txt.json"))
    return (
        F.when(body.isNull() | (F.length(body) == 0), "empty body")
        .when(expected.isNotNull() & (F.length(body) != expected), "wrong size")
        .when(path.endswith(".bin") & ~head.isin("PROP", "PTCH"), "not an object tree")
        .when(path.endswith(".txt") & ~head.startswith("RST"), "not a string table")
        .when(is_json & parsed.isNull(), "not valid JSON")
        .when(table & ~F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, "$.entries", "variant")).startswith("OBJECT"), F.lit(False)), "no entries object")
        .when(path.endswith("champion-summary.json") & ~kind.startswith("ARRAY"), "not a list")
        .when(is_json & ~table & ~path.endswith("champion-summary.json") & ~kind.startswith("OBJECT"), "not an object")
    )
