"""Joins: denormalising, as-of, range, tolerance, dictionary, lookup, upsert.

All but the as-of join are equi-joins, so that they hash-partition and AQE can split skewed keys.  Theta
conditions are turned into equi-joins on buckets; small fixed lists become literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_done(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of todo without a row of done under the same keys: what a resumed run still has to do."""
    return todo.join(done.select(*keys), list(keys), "left_anti")


def with_list(left: DataFrame, right: DataFrame, key: str, item: Column, order: Column, name: str, separator: str = ",") -> DataFrame:
    """left with the items of right under its key as one string in order (null without any)."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), item.cast("string").alias("v"))))
    lists = right.groupBy(key).agg(F.array_join(F.transform(rows, lambda x: x["v"]), separator).alias(name))
    return left.join(lists, key, "left")


def twins(a: DataFrame, b: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """a with b's other columns under a prefix and ``<prefix>missing``, matched on keys (a null key matches a null one)."""
    other = b.select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.col(c).alias(prefix + c) for c in b.columns if c not in keys), F.lit(True).alias("_hit"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return a.join(other, on, "left").withColumn(f"{prefix}missing", F.col("_hit").isNull()).drop("_hit", *(f"_{k}" for k in keys))


def lookup(left: DataFrame, table: DataFrame, name: Column, hashed: Column, value: str, out: str) -> DataFrame:
    """left with the table's value under a name or, failing that, under the name's hash.

    The table has (key, value) with readable keys in lower case and hashes as they are; keys are unique.
    """
    t = table.select(F.col("key").alias("_k"), F.col(value).alias("_v"))
    first = left.withColumn("_name", F.lower(name)).join(t.select(F.col("_k").alias("_name"), F.col("_v").alias("_by_name")), "_name", "left")
    second = first.withColumn("_hash", hashed).join(t.select(F.col("_k").alias("_hash"), F.col("_v").alias("_by_hash")), "_hash", "left")
    return second.withColumn(out, F.coalesce("_by_name", "_by_hash")).drop("_name", "_hash", "_by_name", "_by_hash")


def by_priority(candidates: DataFrame, keys: Sequence[str], priority: Sequence[str]) -> DataFrame:
    """The candidate of each key with the least priority columns."""
    from lexaudit.operators.windows import first_per_key

    return first_per_key(candidates, keys, priority)


def in_list(value: Column, boundaries: Sequence, successor: bool, strict: bool = False) -> Column:
    """The nearest of some literals at or after (successor) or at or before a value; null if there is none.

    The literals become a balanced tree of comparisons, which is compiled: a row takes as many of them as a
    binary search does.
    """
    items = sorted(set(boundaries))

    def tree(low: int, high: int) -> Column:
        """The answer where it is known to be items[low:high] or just beyond."""
        if low == high:
            at = low if successor else low - 1
            return F.lit(items[at]) if 0 <= at < len(items) else F.lit(None)
        mid = (low + high) // 2
        # everything before the split is too small (successor) or not too large (predecessor)
        here = F.lit(items[mid])
        left = (here > value if strict else here >= value) if successor else (here >= value if strict else here > value)
        return F.when(left, tree(low, mid)).otherwise(tree(mid + 1, high))

    return F.when(value.isNotNull(), tree(0, len(items)))


def as_of(left: DataFrame, right: DataFrame, *, by: Sequence[str], at: str, value: str, out: str, forward: bool = False) -> DataFrame:
    """left with the value of right's nearest row at or before (forward: at or after) ``at`` under the same ``by``.

    Both sides are laid out once by ``by`` and time, in ranges, and carried along: no range join, and a hot key
    is many tasks.  At equal times right's rows count as before left's; of right's rows at one time the largest
    value wins.
    """
    from lexaudit.operators.windows import carry_down

    l = left.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.struct(*left.columns).alias("_row"))
    r = right.groupBy(*by, at).agg(F.max(value).alias("_v")).select(*by, F.col(at).alias("_at"), F.lit(0).alias("_side"), "_v", F.lit(None).cast(l.schema["_row"].dataType).alias("_row"))
    order = [F.col("_at").desc() if forward else F.col("_at").asc(), F.col("_side").asc()]
    both = carry_down(l.unionByName(r), "_v", by, order).where(F.col("_row").isNotNull())
    return both.select("_row.*", F.col("_v").alias(out))


def within(left: DataFrame, right: DataFrame, a: str, b: str, tolerance: float) -> DataFrame:
    """Pairs of rows with |a - b| <= tolerance (above 0): an equi-join on buckets of that width and their neighbours."""
    width = F.lit(float(tolerance))
    l = left.withColumn("_bucket", F.explode(F.array(*(F.floor(F.col(a) / width) + d for d in (-1, 0, 1)))))
    r = right.withColumn("_bucket", F.floor(F.col(b) / width))
    return l.join(r, "_bucket").where(F.abs(F.col(a) - F.col(b)) <= width).drop("_bucket")


def find_names(docs: DataFrame, key: str, text: str, names: DataFrame, most_words: int) -> DataFrame:
    """(key, start_word, name) of the names that stand in texts as whole words; of overlapping ones the first counts, of those with one start the longest.

    names(name) may be longer than most_words words; those are left out.  Texts are walked along a trie of the
    names (``dictionary``), so neither side is compared with all of the other.
    """
    from lexaudit.operators import dictionary

    some = names.where(F.size(dictionary.words(F.col("name"))) <= most_words)
    hits = dictionary.leftmost_longest(dictionary.occurrences(docs, key, text, some), key)
    return hits.select(key, F.col("start").alias("start_word"), "name")


def lists_without_one(parts: Column) -> Column:
    """The distinct lists that are left when one element of a list is taken out."""
    out = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat(F.slice(parts, F.lit(1), i), F.slice(parts, i + 2, F.size(parts))))
    return F.when(F.size(parts) > 0, F.array_distinct(out))


def one_left_out(left: DataFrame, right: DataFrame, by: Sequence[str], parts: str, other: str) -> DataFrame:
    """Pairs of rows under the same ``by`` where left's list ``parts`` is right's list ``other`` with one element left out.

    Each list of right gives a digest for each element left out, and an equi-join on ``by`` and the digest finds
    the lists of left, wherever in the list the element stood.  Null lists pair with nothing.
    """
    digest = lambda x: F.sha2(F.to_json(x), 256)
    l = left.withColumn("_list", digest(F.col(parts)))
    r = right.withColumn("_list", F.explode(F.transform(lists_without_one(F.col(other)), digest)))
    return l.join(r, [*by, "_list"]).drop("_list")


def owners(rows: DataFrame, key: str, path: str, main: Column, named: Column) -> DataFrame:
    """(key, owner) of every key with two or more paths: its only main path, else its only named one, else null."""
    ends = lambda c, n: [F.min(c).alias(f"_{n}0"), F.max(c).alias(f"_{n}1")]
    g = rows.groupBy(key).agg(*ends(F.col(path), "all"), *ends(F.when(main, F.col(path)), "main"), *ends(F.when(named, F.col(path)), "named")).where("_all0 <> _all1")
    owner = F.when(F.col("_main0") == F.col("_main1"), F.col("_main0")).when(F.col("_named0") == F.col("_named1"), F.col("_named0"))
    return g.select(key, owner.alias("owner"))


def upsert(old: DataFrame, run: DataFrame, key: str, *, failed: DataFrame | None = None, recheck: bool = False) -> DataFrame:
    """The rows of run over those of old.

    A recheck keeps old rows that run does not have, unless they failed; a plain run keeps only what it has,
    and of old what it has not failed.
    """
    cols = [c for c in old.columns if c != key]
    o = old.select(key, F.struct(*cols).alias("_old"))
    n = run.select(key, F.struct(*cols).alias("_new"))
    j = o.join(n, key, "full_outer")
    if failed is not None:
        j = j.join(failed.select(key).distinct().withColumn("_failed", F.lit(True)), key, "left")
    else:
        j = j.withColumn("_failed", F.lit(None).cast("boolean"))
    gone = F.coalesce("_failed", F.lit(False)) & F.col("_new").isNull()
    if not recheck:
        gone = gone | F.col("_new").isNull()
    return j.where(~gone).withColumn("_row", F.coalesce("_new", "_old")).select(key, "_row.*")
