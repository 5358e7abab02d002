"""Graphs as edge tables: connected components, groups reached, transitive closure."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaudit.operators.paths import nodes, text_of
from lexaudit.sources.shared import written


#: Up to so many edges the tables of a round are sent to the tasks: a few hundred KB, and no shuffle for each join.
FEW = 10_000


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """(node, component) for all ends of edges; component is the smallest node reachable.

    Contraction: every node points to its smallest neighbour, pointers are followed to their ends by doubling, edges
    are redrawn between the ends, until none is left.  A chain in order is one round, however long, as only its smallest node
    is an end.  Minima combine before the shuffle, so hubs are cheap; every round's tables are written to the shared folder.
    """
    e = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct(), "edges")
    found, n = None, e.count()
    for _ in range(max_rounds):
        sent = lambda d: d.hint("broadcast") if n <= FEW else d  # noqa: B023, E731
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")), "up")
        hop = sent(_ends(up, sent))
        if found is None:
            found = hop.hint("merge").withColumnRenamed("to", "component")
        else:
            moved = hop.select(F.col("node").alias("component"), "to")
            found = written(found.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "found")
        ends = e.join(hop.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(hop.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        e = written(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        n = e.count()
        if not n:
            return found
    raise RuntimeError("components did not settle")


def _ends(up: DataFrame, sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, to) where pointers lead; they go down, so doubling ends after the logarithm of the longest way.  sent marks what is looked up."""
    while True:
        two = up.join(sent(up.select(F.col("node").alias("to"), F.col("to").alias("b"))), "to").select("node", "b")
        four = two.join(sent(two.select(F.col("node").alias("b"), F.col("b").alias("c"))), "b")
        up = written(four.select("node", F.col("c").alias("to"), (F.col("b") != F.col("c")).alias("moved")), "hop")
        if up.where("moved").isEmpty():
            return up.drop("moved")


def single_group(components: DataFrame, member_groups: DataFrame) -> DataFrame:
    """(node, group) of ungrouped nodes whose component reaches exactly one group.

    components(node, component); member_groups(node, group) of the nodes that have one.
    """
    reach = components.join(member_groups, "node").groupBy("component").agg(F.count_distinct("group").alias("n"), F.min("group").alias("group")).where("n = 1")
    return components.join(member_groups, "node", "left_anti").join(reach, "component").select("node", "group")


def reachable(edges: DataFrame, a: str, b: str, max_steps: int | None = None) -> DataFrame:
    """(source, target, steps): what is reached from each node, by the fewest steps (semi-naive); within max_steps if given.

    Only pairs not seen before go on, so cycles end.
    """
    e = written(edges.select(F.col(a).alias("source"), F.col(b).alias("target")).where("source IS NOT NULL AND target IS NOT NULL").distinct(), "edges")
    seen = e.withColumn("steps", F.lit(1))
    fresh = seen
    for step in count(2) if max_steps is None else range(2, max_steps + 1):
        onward = fresh.select("source", F.col("target").alias("via")).join(e.select(F.col("source").alias("via"), "target"), "via").select("source", "target").distinct()
        fresh = written(onward.join(seen, ["source", "target"], "left_anti").withColumn("steps", F.lit(step)), "fresh")
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
    return seen


# -- groups of a file's entries -------------------------------------------------------------------

#: Names that take no part in linking, and prefixes of names that join no group.
ATTACKS = r"(?i)basicattack|critattack"
GAME_MODES = ("nightmarebot", "odyssey", "strawberry_")
UNREAD = ("mScriptName", "mLocKeys", "mAlternateName", "__type")
LINKED = "names or is named by a spell of the group"


def strings_of(objects: DataFrame) -> DataFrame:
    """(folder, path, value) of every string in the JSON objects(folder, path, obj), but under fields of labels and own names."""
    own = objects.select("folder", F.col("path").alias("_path"), "obj")
    found = nodes(own, ["folder", "_path"], "obj", leave=UNREAD).select("folder", F.col("_path").alias("path"), text_of(F.col("json")).alias("value"))
    return found.where("value IS NOT NULL").distinct()


def links(strings: DataFrame, names: DataFrame) -> DataFrame:
    """(folder, a, b), both ways, of entries one of which names the other; names(folder, name, path), the first path of a name."""
    n = names.groupBy("folder", F.lower("name").alias("low")).agg(F.min("path").alias("b"))
    one = strings.select("folder", F.col("path").alias("a"), F.lower("value").alias("low")).join(n, ["folder", "low"]).where("a <> b").select("folder", "a", "b")
    return one.unionByName(one.select("folder", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def assign_groups(spells: DataFrame, edges: DataFrame, later: DataFrame | None = None) -> DataFrame:
    """(folder, path, group, source, joined_by) of entries that share a group with another.

    spells(folder, path, name, object_group, is_slot).  In order: the group of an ability object; a slot
    entry starts one; the longest slot name that starts an entry's own at a word boundary; the later file's
    object (later(folder, name, root, where)); and entries in no group that are linked to each other join
    the one group that their links reach, if it is one.  Attacks join only by name, game-mode entries never.

    Every side grows with the entries, so joins are by shuffle: by the size of its files Spark takes a table of keys for
    small and sends it to every task whole.
    """
    key = ["folder", "path"]
    low = F.lower("name")
    mode = F.coalesce(low.startswith(GAME_MODES[0]) | low.startswith(GAME_MODES[1]) | low.startswith(GAME_MODES[2]), F.lit(False)) & F.col("object_group").isNull()
    s = spells.withColumn("mode", mode).withColumn("attack", F.col("name").rlike(ATTACKS))
    own = s.where("object_group IS NOT NULL").select(*key, F.col("object_group").alias("group"), F.lit("AbilityObject").alias("source"), F.lit("AbilityObject").alias("joined_by"))
    seeds = s.where("is_slot AND NOT mode").select("folder", "path", "name", "object_group")
    group = F.concat(F.lit("script name "), F.col("seed"))
    started = seeds.where("object_group IS NULL").select(*key, F.concat(F.lit("script name "), "name").alias("group"), F.lit("slot spell").alias("source"), F.lit("slot spell").alias("joined_by"))
    done = own.unionByName(started)
    # the longest seed name wins; of equal ones the first path
    free = s.join(done.select(*key).hint("merge"), key, "left_anti").where("NOT mode")
    by = seeds.select("folder", F.col("name").alias("seed"), F.col("path").alias("seed_path"))
    # an entry's own beginnings, cut at word boundaries, meet the seeds in an equi-join
    cuts = F.filter(F.sequence(F.lit(1), F.length("name")), lambda i: (i == F.length("name")) | F.substr("name", i + 1, F.lit(1)).rlike("[A-Z0-9_]"))
    starts = free.where("name <> ''").withColumn("_begin", F.explode(F.transform(cuts, lambda i: F.lower(F.substr("name", F.lit(1), i)))))
    # many entries share a short beginning: they pass by the seeds of their task, one of each name, and need not be held to be sorted
    first = F.min_by(F.struct("seed", "seed_path"), F.struct(-F.length("seed"), "seed_path"))
    firsts = by.where("seed <> ''").groupBy("folder", F.lower("seed").alias("_begin")).agg(first.alias("_first")).select("folder", "_begin", "_first.*")
    starts = starts.join(firsts.hint("shuffle_hash"), ["folder", "_begin"])
    best = starts.groupBy(*key).agg(F.min_by("seed", F.struct(-F.length("seed"), "seed_path")).alias("seed"))
    done = done.unionByName(best.select(*key, group.alias("group"), F.lit("slot spell").alias("source"), F.lit("script-name prefix").alias("joined_by")))
    if later is not None:
        free = s.join(done.select(*key).hint("merge"), key, "left_anti").where("NOT mode AND NOT attack")
        found = free.withColumn("_low", F.lower("name")).join(later.select("folder", F.lower("name").alias("_low"), F.lower("root").alias("_root"), "where").hint("merge"), ["folder", "_low"])
        found = found.join(by.select("folder", "seed", F.lower("seed").alias("_root")).hint("merge"), ["folder", "_root"])
        done = done.unionByName(found.select(*key, group.alias("group"), F.lit("slot spell").alias("source"), F.concat(F.lit("AbilityObject in "), "where").alias("joined_by")))
    done = written(done, "groups")
    # linked entries: those of ability objects, game modes and attacks take no part
    out_of = s.where("object_group IS NOT NULL OR mode OR attack").select("folder", F.col("path").alias("x")).hint("merge")
    e = edges.join(out_of, (edges["folder"] == out_of["folder"]) & (F.col("a") == F.col("x")), "left_anti").join(out_of.withColumnRenamed("folder", "f2"), (F.col("folder") == F.col("f2")) & (F.col("b") == F.col("x")), "left_anti")
    joined = done.select("folder", F.col("path").alias("b"), "group")
    loose = e.join(done.select("folder", F.col("path").alias("a")), ["folder", "a"], "left_anti")
    reach = loose.join(joined, ["folder", "b"]).select(F.concat_ws("\x00", "folder", "a").alias("node"), "group")
    among = loose.join(joined, ["folder", "b"], "left_anti").select(F.concat_ws("\x00", "folder", "a").alias("a"), F.concat_ws("\x00", "folder", "b").alias("b"))
    alone = reach.select(F.col("node").alias("a"), F.col("node").alias("b"))
    comps = connected_components(among.unionByName(alone), "a", "b")
    one = comps.join(reach, "node").groupBy("component").agg(F.count_distinct("group").alias("n"), F.min("group").alias("group")).where("n = 1")
    last = comps.join(one, "component").select(F.split("node", "\x00").alias("n"), "group")
    done = done.unionByName(last.select(F.col("n")[0].alias("folder"), F.col("n")[1].alias("path"), "group", F.lit("slot spell").alias("source"), F.lit(LINKED).alias("joined_by")))
    shared = done.groupBy("folder", "group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n").hint("merge")
    return done.join(shared, ["folder", "group"]).select("folder", "path", "group", "source", "joined_by")
