"""JSON documents as tables of key paths, and what differs between two of them, renamed paths included.

Documents become VARIANT once and are unfolded level by level with ``variant_explode``, so a document
of any depth is a table without a row of Python; each level is written to the shared folder.  Keys are sorted and
numbers in one form within a VARIANT, so equal values have equal digests whatever their layout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaudit.sources.shared import written


def step(key: Column, pos: Column) -> Column:
    """One step of a path: /key, or [place] in a list; ~, / and [ in keys are written ~0, ~1 and ~2."""
    name = key
    for c, code in (("~", "~0"), ("/", "~1"), ("[", "~2")):
        name = F.replace(name, F.lit(c), F.lit(code))
    return F.coalesce(F.concat(F.lit("/"), name), F.concat(F.lit("["), pos.cast("string"), F.lit("]")))


def nodes(docs: DataFrame, keys: Sequence[str], doc: str, leave: Sequence[str] = ()) -> DataFrame:
    """(keys, path, up, key, leaf, json) of every value within the JSON texts of a column but the whole.

    up holds the paths above, outermost first; json is the value as canonical text; a leaf holds nothing (a scalar, an
    empty object or list).  Fields named in ``leave`` are left out with what they hold.  Null and unreadable
    documents, and those that are a scalar, give no rows; of repeated keys none can be read.
    """
    tvf = docs.sparkSession.tvf
    level = docs.select(*keys, F.lit("").alias("path"), F.array().cast("array<string>").alias("up"), F.try_parse_json(F.col(doc)).alias("v"))
    found = None
    while True:
        below = level.lateralJoin(tvf.variant_explode(F.col("v").outer()))
        if leave:
            below = below.where(F.col("key").isNull() | ~F.col("key").isin(*leave))
        up = F.when(F.col("path") == "", F.col("up")).otherwise(F.array_append("up", F.col("path")))
        json = F.to_json("value")
        leaf = ~json.startswith("{") & ~json.startswith("[") | json.isin("{}", "[]")
        level = written(below.select(*keys, F.concat("path", step(F.col("key"), F.col("pos"))).alias("path"), up.alias("up"), "key", leaf.alias("leaf"), json.alias("json"), F.col("value").alias("v")), "nodes")
        if level.isEmpty():
            break
        found = level.drop("v") if found is None else found.unionByName(level.drop("v"))
        level = level.where("NOT leaf").drop("key", "leaf", "json")
    return level.drop("v") if found is None else found


def text_of(json: Column) -> Column:
    """The string that a JSON text stands for; null if it is no string."""
    return F.when(json.startswith('"'), F.try_variant_get(F.try_parse_json(json), "$", "string"))


def _unequal(a: DataFrame, b: DataFrame, keys: list[str], doc: str) -> DataFrame:
    """(keys, _side, _doc) of the documents of both tables, but of those that have the same text on both sides and so no difference."""
    both = a.select(*keys, F.lit("a").alias("_side"), F.col(doc).alias("_doc")).unionByName(b.select(*keys, F.lit("b").alias("_side"), F.col(doc).alias("_doc")))
    x, y = F.get("_docs", F.lit(0)), F.get("_docs", F.lit(1))
    same = (F.size("_docs") == 2) & (x["_side"] != y["_side"]) & x["_doc"].eqNullSafe(y["_doc"])
    for k in keys:
        same = same & F.col(k).isNotNull()  # null keys meet nothing
    held = both.groupBy(*keys).agg(F.collect_list(F.struct("_side", "_doc")).alias("_docs")).where(~F.coalesce(same, F.lit(False)))
    return held.select(*keys, F.inline("_docs"))


def differences(a: DataFrame, b: DataFrame, keys: Sequence[str], doc: str) -> DataFrame:
    """(keys, change, path, other) between the documents of two tables under unique keys.

    renamed: a value that only a has at ``path`` and only b at ``other``, where it is the only one of its content that a
    alone has in this document, and the only one that b alone has; what it holds is not told again.  removed
    and added: other leaves at paths that one side alone has.  changed: a leaf whose value differs, or
    that holds other values on one side.  A document that one side lacks is all removed or all added.
    """
    keys = list(keys)
    found = nodes(_unequal(a, b, keys, doc), [*keys, "_side"], "_doc").select(*keys, "_side", "path", F.struct("up", "leaf", F.sha2("json", 256).alias("digest")).alias("n"))
    side = lambda s: found.where(F.col("_side") == s).select(*keys, "path", F.col("n").alias(s))
    both = written(side("a").join(side("b"), [*keys, "path"], "full_outer"), "both")
    changed = both.where("a IS NOT NULL AND b IS NOT NULL AND a.digest <> b.digest AND (a.leaf OR b.leaf)").select(*keys, F.lit("changed").alias("change"), "path", F.lit(None).cast("string").alias("other"))
    gone, come = (both.where(f"{o} IS NULL").select(*keys, "path", f"{s}.*") for s, o in (("a", "b"), ("b", "a")))
    one = lambda df: df.groupBy(*keys, "digest").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    pairs = written(one(gone).join(one(come).withColumnRenamed("path", "other"), [*keys, "digest"]).select(*keys, "path", "other"), "renamed")

    def outside(df: DataFrame, column: str) -> DataFrame:
        """Rows of df that are not below a renamed path."""
        tops = pairs.select(*keys, F.col(column).alias("_top"))
        below = df.select(*keys, "path", F.explode("up").alias("_top")).join(tops, [*keys, "_top"]).select(*keys, "path").distinct()
        return df.join(below, [*keys, "path"], "left_anti")

    # a pair stands by itself unless both its ends are below those of another
    above = gone.select(*keys, "path", F.explode("up").alias("_a")).join(pairs.select(*keys, "path", "other"), [*keys, "path"])
    ends = come.select(*keys, F.col("path").alias("other"), F.explode("up").alias("_b"))
    tops = pairs.select(*keys, F.col("path").alias("_a"), F.col("other").alias("_b"))
    inner = above.join(tops, [*keys, "_a"]).join(ends, [*keys, "other", "_b"]).select(*keys, "path").distinct()
    renamed = pairs.join(inner, [*keys, "path"], "left_anti")
    told = lambda df, change, column: outside(df, column).where("leaf").join(pairs.select(*keys, F.col(column).alias("path")), [*keys, "path"], "left_anti").select(*keys, F.lit(change).alias("change"), "path", F.lit(None).cast("string").alias("other"))
    return changed.unionByName(renamed.select(*keys, F.lit("renamed").alias("change"), "path", "other")).unionByName(told(gone, "removed", "path")).unionByName(told(come, "added", "other"))
