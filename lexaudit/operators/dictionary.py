"""Names found in texts: the names as a trie, which is an edge table, and texts walked along it by joins.

Texts are cut into words once, and only places whose word is in some name go on.  From each place that starts a
name the walk takes an edge a round, by equi-joins on the place and on (node, word); a start without an edge ends
there, so a long name costs its own matches and not the volume of the texts.  Of the names found, the one that
starts first counts, of those with one start the longest, and what overlaps it does not: places that
no name spans part a text into islands, and each is settled by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexaudit.sources.shared import written

#: Tries up to so many bytes of names are broadcast, after they were measured; larger ones are shuffled.
MOST_BROADCAST = 16 * 1024 * 1024
HITS = "array<struct<start:int,end:int,name:string>>"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits (a final sigma is written as any other)."""
    low = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ς"), F.lit("σ"))
    return F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def trie(names: DataFrame) -> DataFrame:
    """(node, word, child, ends, more) of names(name): a node is what was read so far, ends says that child is a name, more that one goes on."""
    n = names.select(words(F.col("name")).alias("w")).where(F.size("w") > 0).distinct()
    upto = lambda i: F.array_join(F.slice("w", F.lit(1), i), " ")
    n = n.select("w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i"))
    e = n.select(upto(F.col("i") - 1).alias("node"), F.get("w", F.col("i") - 1).alias("word"), upto(F.col("i")).alias("child"), (F.col("i") == F.size("w")).alias("ends"), (F.col("i") < F.size("w")).alias("more"))
    return e.groupBy("node", "word", "child").agg(F.max("ends").alias("ends"), F.max("more").alias("more"))


def occurrences(docs: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """(key, start, end, name) of every place where the words of a name stand, overlapping ones too; places count words from 0."""
    edges = written(trie(names), "trie")
    size = edges.agg(F.sum(F.octet_length("child") + F.octet_length("node"))).first()[0] or 0
    near = F.broadcast if size <= MOST_BROADCAST else (lambda df: df)
    places = docs.select(F.col(key), F.posexplode(words(F.col(text))).alias("pos", "word"))
    places = written(places.join(near(edges.select("word").distinct()), "word", "left_semi"), "places")
    front = places.select(key, F.col("pos").alias("start"), "pos", "word", F.lit("").alias("node"))
    found = None
    while True:
        walked = front.join(near(edges), ["node", "word"]).select(key, "start", F.col("pos").alias("at"), "child", "ends", "more")
        walked = written(walked, "walked")
        if walked.isEmpty():
            break
        hits = walked.where("ends").select(key, "start", (F.col("at") + 1).alias("end"), F.col("child").alias("name"))
        found = hits if found is None else found.unionByName(hits)
        on = walked.where("more").select(key, "start", (F.col("at") + 1).alias("pos"), F.col("child").alias("node"))
        front = on.join(places, [key, "pos"])
    return found if found is not None else walked.select(key, "start", F.col("at").alias("end"), F.col("child").alias("name"))


def leftmost_longest(hits: DataFrame, key: str) -> DataFrame:
    """(key, start, end, name) of hits that count: the first, then the first that starts where it has ended or later, and so on; of one start the longest."""
    one = hits.groupBy(key, "start").agg(F.max(F.struct("end", "name")).alias("h")).select(key, "start", "h.*")
    by_start = Window.partitionBy(key).orderBy("start")
    before = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    one = one.withColumn("_new", F.when(before.isNull() | (before <= F.col("start")), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(by_start))
    rows = F.array_sort(F.collect_list(F.struct("start", "end", "name")))
    nothing = F.struct(F.lit(-1).alias("end"), F.array().cast(HITS).alias("kept"))
    fold = lambda a, x: F.when(x["start"] >= a["end"], F.struct(x["end"].alias("end"), F.array_append(a["kept"], x).alias("kept"))).otherwise(a)
    kept = one.groupBy(key, "_island").agg(F.aggregate(rows, nothing, fold, lambda a: a["kept"]).alias("kept"))
    return kept.select(key, F.explode("kept").alias("h")).select(key, "h.*")
