"""Values that read other values, evaluated level by level, and kept up to date when definitions change.

Definitions are rows terms(group, name, reads, coef): within a group, a name's value is the sum of its
coefficients, each times the value it reads (a null ``reads`` is a constant).  Evaluation goes level by level: what a round
finds meets the terms that read it, each term once, and goes into the sums of the names that wait for it.  Of groups with
few terms a task has all; a group of very many is never in one task.  After a change only the names that it reaches
through its readers are computed again, in the groups it touches; all other results are taken as they are, and parts
of the tables without a changed group are not opened.

Edge cases: a name that reads something undefined, or itself by way of others, has no value but a problem, and
so have its readers; a null coefficient in a change removes the name; terms with a null group or name are left out;
repeated terms count as often as they are there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaudit.sources.publish import Published
from lexaudit.sources.shared import whole_groups, written

KEY = ["group", "name"]
#: Groups of up to so many terms are evaluated in one task, terms of whole groups together, and so many terms at once.
SMALL, AT_ONCE = 10_000, 100_000
CIRCULAR = "reads itself, or what has no value"


def evaluate(terms: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(group, name, value, problem) of all names that terms define; known(group, name, value) are values given before."""
    return _evaluated(written(_usable(terms), "pending"), known)


def _usable(terms: DataFrame, *also: str) -> DataFrame:
    return terms.select(*also, *KEY, "reads", F.col("coef").cast("double").alias("coef")).where("`group` IS NOT NULL AND name IS NOT NULL")


def _evaluated(terms: DataFrame, known: DataFrame | None = None, *also: str) -> DataFrame:
    """evaluate with columns that are the same for all terms of a group; terms is a table, as it is read several times.

    One round a level of reading; each writes the terms with what they read, and the sums with how many terms they still
    wait for, to the shared folder.  Both get shorter, and terms that were met do not come again.
    """
    read = F.col("reads").isNotNull()
    sums = lambda d: written(d.groupBy(*also, *KEY).agg(F.sum("value").alias("value"), F.sum("waits").alias("waits")), "values")
    state = sums(terms.select(*also, *KEY, F.when(~read, F.col("coef")).alias("value"), F.when(read, 1).otherwise(0).alias("waits")))
    edges, found, rounds = terms.where(read), None, 0
    while True:
        done = state.where("waits = 0")
        found = done if found is None else found.unionByName(done)
        fresh = done.select("group", F.col("name").alias("reads"), "value")
        if known is not None and not rounds:
            fresh = fresh.unionByName(known.select("group", F.col("name").alias("reads"), "value"))
        fresh = fresh.where("value IS NOT NULL")
        if fresh.isEmpty() or edges.isEmpty():
            break
        met = written(edges.join(fresh.hint("merge"), ["group", "reads"], "left").select(*also, *KEY, "reads", "coef", "value"), "met")
        edges = met.where("value IS NULL").drop("value")
        told = met.where("value IS NOT NULL").select(*also, *KEY, (F.col("coef") * F.col("value")).alias("value"), F.lit(-1).cast("long").alias("waits"))
        state, rounds = sums(state.where("waits > 0").unionByName(told)), rounds + 1
    found = found.select(*also, *KEY, "value", F.lit(None).cast("string").alias("problem"))
    if edges.isEmpty():
        return found
    there = terms.select("group", F.col("name").alias("reads")).distinct()
    if known is not None:
        there = there.unionByName(known.select("group", F.col("name").alias("reads"))).distinct()
    lost = edges.select(*also, *KEY, "reads").join(there.withColumn("_there", F.lit(True)), ["group", "reads"], "left")
    undefined = F.min(F.when(F.col("_there").isNull(), F.col("reads")))
    lost = lost.groupBy(*also, *KEY).agg(F.coalesce(F.concat(F.lit("reads "), undefined, F.lit(", which is not defined")), F.lit(CIRCULAR)).alias("problem"))
    return found.unionByName(lost.select(*also, *KEY, F.lit(None).cast("double").alias("value"), "problem"))


def reached(starts: DataFrame, terms: DataFrame) -> DataFrame:
    """(group, name) of starts and of all names that read one of them, directly or by way of others."""
    edges = written(terms.where("reads IS NOT NULL").select("group", "reads", "name").distinct(), "readers")
    fresh = written(starts.select(*KEY).distinct(), "reached")
    seen = fresh
    while not fresh.isEmpty():
        onward = fresh.select("group", F.col("name").alias("reads")).join(edges, ["group", "reads"]).select(*KEY).distinct()
        fresh = written(onward.join(seen, KEY, "left_anti"), "reached")
        seen = seen.unionByName(fresh)
    return seen


def create(store: Published, terms: DataFrame) -> int:
    """Publishes terms(part, group, name, reads, coef), laid out by part, and the results of all of them."""
    return store.publish({"terms": _usable(terms, "part"), "results": lambda made: _results(made["terms"])}, part="part")


def _results(terms: DataFrame) -> DataFrame:
    """Results of a table of terms, in the parts of their groups.

    Groups of up to SMALL terms in one part are evaluated in the task that has them; of the others no task has all terms.
    """
    mark = F.xxhash64("part")
    sizes = terms.groupBy("group").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi"), F.count(F.lit(1)).alias("n"))
    others = written(sizes.where((F.col("lo") != F.col("hi")) | (F.col("n") > SMALL)).select("group"), "others")
    if others.isEmpty():
        return _in_groups(terms, "part")
    rest = terms.join(others, "group", "left_semi")
    wide = evaluate(rest).join(rest.select("group", "part").distinct(), "group")
    return _in_groups(terms.join(others, "group", "left_anti"), "part").unionByName(wide)


def _in_groups(terms: DataFrame, *also: str) -> DataFrame:
    """evaluate for groups of few terms, with columns that are the same for all terms of a group: rows of whole groups at once."""
    rows = terms.select(*also, *KEY, "reads", "coef").repartition("group").sortWithinPartitions("group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "group", AT_ONCE):
            yield from levels(t, also).to_batches()

    out = rows.select(*also, *KEY).schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out)
    return rows.mapInArrow(run, f"{schema}, value double, problem string")


def levels(t: pa.Table, also: Sequence[str] = ()) -> pa.Table:
    """evaluate of a table of terms whose groups stand together, level by level for all of them."""
    n = t.num_rows
    group = t.column("group").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    both = pa.chunked_array([*t.column("name").chunks, *t.column("reads").chunks], t.schema.field("name").type).combine_chunks().dictionary_encode()
    codes, words = both.indices.fill_null(0).to_numpy().astype(np.int64), both.dictionary
    keys, first, name = np.unique(group * len(words) + codes[:n], return_index=True, return_inverse=True)
    constant = t.column("reads").is_null().to_numpy()
    given = t.column("coef").is_valid().to_numpy()
    coef = np.where(given, t.column("coef").to_numpy(), 0.0)
    add = lambda at, x=None: np.bincount(at, x, len(keys))
    value, has, waits = add(name[constant], coef[constant]), add(name[constant & given]) > 0, add(name[~constant])
    # terms that read: what they read (-1: not there), whose they are
    at = np.flatnonzero(~constant)
    wanted = group[at] * len(words) + codes[n:][at]
    source = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    source = np.where(keys[source] == wanted, source, -1) if len(keys) else source
    lone, fresh = at[source < 0], (waits == 0) & has
    at, source = at[source >= 0], source[source >= 0]
    while len(at) and fresh.any():
        met = fresh[source]
        to, there = name[at[met]], given[at[met]]
        value += add(to[there], (coef[at[met]] * value[source[met]])[there])
        has |= add(to[there]) > 0
        before, waits = waits, waits - add(to)
        at, source = at[~met], source[~met]
        fresh = (before > 0) & (waits == 0) & has
    undefined: dict[int, str] = {}
    for i in lone.tolist():
        word = words[int(codes[n + i])].as_py()
        undefined[int(name[i])] = min(word, undefined.get(int(name[i]), word))
    open_ = waits > 0
    problem = [None] * len(keys)
    for i in np.flatnonzero(open_).tolist():
        problem[i] = f"reads {undefined[i]}, which is not defined" if i in undefined else CIRCULAR
    columns = [t.column(c).take(pa.array(first)) for c in (*also, *KEY)]
    return pa.table([*columns, pa.array(value, pa.float64(), mask=open_ | ~has), pa.array(problem, pa.string())], [*also, *KEY, "value", "problem"])


def apply_edits(store: Published, edits: DataFrame) -> int:
    """Publishes the version after edits(part, group, name, reads, coef), which replace all terms of the names they give.

    A group stays in its part.  The driver gets the parts that are touched, nothing else.
    """
    base = store.version()
    edits = written(edits.select("part", *KEY, "reads", F.col("coef").cast("double").alias("coef")), "edits")
    parts = sorted(r[0] for r in edits.select("part").distinct().collect())
    if not parts:
        return base
    changed, groups = edits.select(*KEY).distinct(), edits.select("group", "part").distinct()
    old_terms, old = store.read("terms", base, parts), store.read("results", base, parts)
    terms = written(old_terms.join(changed, KEY, "left_anti").unionByName(edits.where("coef IS NOT NULL")), "terms")
    own = terms.join(groups.select("group"), "group", "left_semi")
    touched = written(reached(changed, own), "touched")
    known = old.join(groups.select("group"), "group", "left_semi").join(touched, KEY, "left_anti")
    fresh = evaluate(own.join(touched, KEY, "left_semi"), known).join(groups, "group")
    return store.publish({"terms": terms, "results": old.join(touched, KEY, "left_anti").unionByName(fresh)}, part="part", only=parts, based_on=base)
