"""Controlled errors: where one can be planted, what it changes, and whether the planted one holds up.

Sites and changes are tables; a change is applied to JSON documents on the executors, the changed document
is resolved again, and a list of invariants tells why a planted error is refused.  A planted set is
reproduced from its manifest and compared by content hash.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaudit.functions import numeric

# Sizes of the changes.
RULES = ("stat_ratio", "base_values", "other_value", "drop_term", "multiplier")
RATIO_FACTORS = (0.5, 0.75, 1.5, 2.0)
BASE_FACTORS = (0.75, 0.8, 1.2, 1.25)
MULTIPLIER_STEPS = (1, -1)
MULTIPLIER_FACTORS = (0.5, 1.5, 2.0)
UNIT_MULTIPLIERS = (0, 1, 100, 0.01, 1000, 0.001, -1)
OTHER_RANGE = (0.25, 4.0)


def scaled_plans(sites: DataFrame, values: str, factors: Sequence[float]) -> DataFrame:
    """sites with factor and new_values for each factor that scales exactly at the values' own precision.

    Values that a coarse step divides must stay on that step.
    """
    x = sites.select("*", F.explode(F.array(*map(F.lit, factors))).alias("factor"))
    x = x.withColumn("new_values", numeric.scaled(F.col(values), F.col("factor"))).where(F.col("new_values").isNotNull() & (F.col("new_values") != F.col(values)))
    step = numeric.grid_step(F.col(values))
    on = F.forall("new_values", lambda v: F.abs(v / step - F.round(v / step)) < 1e-6)
    return x.where(step.isNull() | on)


def ratio_plans(sites: DataFrame, value: str) -> DataFrame:
    """sites with factor and new_value for each ratio factor, to two decimals at least exactly."""
    x = sites.select("*", F.explode(F.array(*map(F.lit, RATIO_FACTORS))).alias("factor")).withColumn("new_value", F.round(F.col(value) * F.col("factor"), 6))
    places = F.greatest(F.lit(2), numeric.decimals(F.col(value)))
    p = F.pow(F.lit(10.0), places)
    return x.where((F.abs(F.round(F.col("new_value") * p) - F.col("new_value") * p) < 1e-6) & (F.col("new_value") != F.col(value)))


def multiplier_plans(sites: DataFrame, value: str) -> DataFrame:
    """sites with new_value: whole multipliers a step up or down (1 at least), others by a factor; units never."""
    whole = F.col(value) == F.floor(value)
    steps = F.array(*(F.col(value) + s for s in MULTIPLIER_STEPS))
    scaled = F.array(*(F.round(F.col(value) * f, 6) for f in MULTIPLIER_FACTORS))
    x = sites.where(~F.col(value).isin(*UNIT_MULTIPLIERS)).select("*", F.explode(F.when(whole, steps).otherwise(scaled)).alias("new_value"))
    return x.where((F.col("new_value") > 0) & ~F.col("new_value").isin(*UNIT_MULTIPLIERS) & (~whole | (F.col("new_value") >= 1)))


def drop_plans(sites: DataFrame, parts: str) -> DataFrame:
    """sites with dropped (from 0) and new_parts for each part of at least two."""
    x = sites.where(F.size(parts) >= 2).select("*", F.posexplode(parts).alias("dropped", "_p")).drop("_p")
    return x.withColumn("new_parts", F.concat(F.slice(parts, F.lit(1), F.col("dropped")), F.slice(parts, F.col("dropped") + 2, F.size(parts))))


def other_value_plans(sites: DataFrame, candidates: DataFrame, related: Callable[[Column, Column], Column]) -> DataFrame:
    """sites(record, name, shown) with another value(record, other, other_shown) of a related name, within a quarter and four times."""
    j = sites.join(candidates, "record").where((F.lower("name") != F.lower("other")) & related(F.col("name"), F.col("other")))
    r = F.col("other_shown") / F.col("shown")
    return j.where((F.col("shown") != 0) & r.between(*OTHER_RANGE) & (F.col("other_shown") != F.col("shown")))


def anchors(values: DataFrame, others: DataFrame, id_: str, value: str, other: str, kind: str) -> DataFrame:
    """(id, kind, where) of the values elsewhere that agree with a value within a millionth: what makes a change noticeable.

    An equi-join on the id and a bucket of the value, whose width follows its size.
    """
    bucket = lambda c: F.round(c, 4)
    width = F.lit(0.0001)
    v = values.select(F.col(id_).alias("id"), F.col(value).alias("_v"), F.explode(F.array(*(bucket(F.col(value) + d * width) for d in (-1, 0, 1)))).alias("_b"))
    o = others.select(F.col(id_).alias("id"), F.col(other).alias("_o"), "where", bucket(F.col(other)).alias("_b"))
    return v.join(o, ["id", "_b"]).where(numeric.close(F.col("_v"), F.col("_o"))).select("id", F.lit(kind).alias("kind"), "where").distinct()


# -- changing documents ---------------------------------------------------------------------------


def put_at(tree, path: Sequence, value):
    """A copy of the tree with the value at a path; only what lies on the path is copied."""
    if not path:
        return value
    key, rest = path[0], path[1:]
    if isinstance(tree, list):
        return [put_at(x, rest, value) if i == key else x for i, x in enumerate(tree)]
    return {k: put_at(v, rest, value) if k == key else v for k, v in tree.items()}


def removed_at(tree, path: Sequence):
    """A copy of the tree without the list element at a path."""
    *up, i = path
    own = tree
    for k in up:
        own = own[k]
    return put_at(tree, up, own[:i] + own[i + 1 :])


def paths_of(tree, at: tuple = ()) -> Iterator[tuple]:
    """All paths of keys and places in a tree."""
    yield at
    if isinstance(tree, dict):
        for k, v in tree.items():
            yield from paths_of(v, (*at, k))
    elif isinstance(tree, list):
        for i, v in enumerate(tree):
            yield from paths_of(v, (*at, i))


def apply_changes(rows: DataFrame) -> DataFrame:
    """rows(id, doc, path, value) with changed: doc with the JSON value at the JSON path (a null value drops the element)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for doc, path, value in zip(p["doc"], p["path"], p["value"], strict=True):
                tree, at = json.loads(doc), json.loads(path)
                out.append(json.dumps(removed_at(tree, at) if value is None else put_at(tree, at, json.loads(value)), ensure_ascii=False, separators=(",", ":"), sort_keys=True))
            yield p.assign(changed=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, changed string")


CHECKS = (
    "the planted record is missing after resolving again",
    "the planted text is not the text the change made",
    "the planted input does not differ from the original",
    "the change added, removed or renamed something",
    "a text change changed the game data",
    "another spell line changed",
    "a level-up row changed",
    "the placeholder shows the same value as before, or none",
    "the planted value turned negative",
    "the left-out term leaves a value of 0",
    "the anchor is gone from the planted input",
)


def first_failure(conditions: Mapping[str, Column]) -> Column:
    """The first of the checks, in order, whose condition does not hold; null if all do.  A null condition fails."""
    unknown = set(conditions) - set(CHECKS)
    if unknown:
        raise ValueError(f"no such check: {sorted(unknown)}")
    return F.coalesce(*(F.when(~F.coalesce(conditions[c], F.lit(False)), F.lit(c)) for c in CHECKS if c in conditions))


def self_check(planted: DataFrame) -> DataFrame:
    """planted with problem: null if the error may be written.

    Reads resolved, text, planned_text, input, original, id_same, shape, planned_shape, data_same, is_text,
    others_same, level_up_same, shown, shown_before, base, base_before, dropped, has_scalings, anchored.
    """
    c = F.col
    negative = lambda x: F.exists(x, lambda v: v < 0)
    return planted.withColumn(
        "problem",
        first_failure(
            {
                CHECKS[0]: c("resolved"),
                CHECKS[1]: c("text") == c("planned_text"),
                CHECKS[2]: (c("input") != c("original")) & c("id_same"),
                CHECKS[3]: c("shape") == c("planned_shape"),
                CHECKS[4]: ~c("is_text") | c("data_same"),
                CHECKS[5]: c("others_same"),
                CHECKS[6]: c("level_up_same"),
                CHECKS[7]: c("shown").isNotNull() & (c("shown") != c("shown_before")),
                CHECKS[8]: ~negative(c("base")) | negative(c("base_before")),
                CHECKS[9]: ~c("dropped") | c("has_scalings") | ~F.forall("base", lambda v: v == 0),
                CHECKS[10]: c("anchored"),
            }
        ),
    )


# -- the planted set ------------------------------------------------------------------------------


def numbered_set(drawn: DataFrame, name: str, seed: int) -> DataFrame:
    """drawn with id ``<name>-001`` on, in hash order of record_id."""
    from lexaudit.operators.sampling import draw_key
    from lexaudit.operators.windows import numbered

    n = numbered(drawn, [draw_key(seed, "number", F.col("record_id")), F.col("record_id")], "_n")
    return n.withColumn("id", F.format_string(f"{name}-%03d", F.col("_n"))).drop("_n")


def content_hash(document: Column) -> Column:
    return F.sha2(document, 256)


def verify(manifest: DataFrame, again: DataFrame) -> DataFrame:
    """(id, problem) of planted errors that a second making does not give back: missing, surplus or different."""
    m = manifest.select("id", F.col("sha256").alias("_m"))
    a = again.select("id", content_hash(F.col("input")).alias("_a"))
    problem = F.when(F.col("_a").isNull(), "missing").when(F.col("_m").isNull(), "not in the manifest").when(F.col("_a") != F.col("_m"), "different content")
    return m.join(a, "id", "full_outer").select("id", problem.alias("problem")).where("problem IS NOT NULL")


def answer(rule: Column, name: Column, before: Column, after: Column, anchor: Column) -> Column:
    """One sentence on what is wrong and what shows it."""
    what = (
        F.when(rule == "stat_ratio", F.format_string("@%s@ scales with a ratio of %s instead of %s", name, after, before))
        .when(rule == "base_values", F.format_string("@%s@ has base values of %s instead of %s", name, after, before))
        .when(rule == "other_value", F.format_string("the text shows @%s@ where it should show @%s@", after, before))
        .when(rule == "drop_term", F.format_string("@%s@ lacks the term %s", name, before))
        .when(rule == "multiplier", F.format_string("@%s@ is multiplied by %s instead of %s", name, after, before))
    )
    return F.concat(what, F.lit("; it disagrees with "), anchor, F.lit("."))
