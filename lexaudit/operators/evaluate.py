"""Scoring of checkers: flags matched to cases, judged once each, voted on, and reported.

A checker or a judge is any function on batches of rows; none is called over a network here.  What has been
judged is kept in a cache table by a key made of the content, so a resumed run judges only what is new.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaudit.functions import hashing, text
from lexaudit.operators import aggregates, sampling
from lexaudit.operators.windows import last_per_key

SCRIPT = "script"
ATTEMPTS = 4
#: Runs of all methods, at most.
MOST_RUNS = 1000
#: Share of failed calls from which a run carries a warning.
MOST_FAILED = 0.05


class StopRun(Exception):
    """The account is not accepted: no further call makes sense."""


def reduced_flags(lines: DataFrame) -> DataFrame:
    """(method, run, id, record_id, names) of every flag of log lines, in the common form.

    lines has method, run, id, planted_id (or null), flags array<struct<names,...>>; of several lines of an id
    only the last (by pos) counts.
    """
    last = last_per_key(lines.select("method", "run", "id", "pos", "planted_id", F.to_json("flags").alias("flags")), ["method", "run", "id"], ["pos"])
    f = last.withColumn("f", F.explode(F.from_json("flags", "array<struct<names:string,reason:string>>")))
    return f.select("method", "run", "id", F.coalesce("planted_id", "id").alias("match_id"), text.reduce_names(F.col("f.names")).alias("names"))


def reduced_script_flags(flags: DataFrame) -> DataFrame:
    """Script flags(id, names, start, ...) with reduced names: those of typed numbers by the words around the number."""
    typed = text.typed_flag_words(F.col("names"), F.col("start"))
    return flags.withColumn("names", text.reduce_names(F.coalesce(typed, F.col("names"))))


def on_cases(cases: DataFrame, flags: DataFrame) -> DataFrame:
    """Flags on the record of each case: a real case by its record id, a planted one by its own id."""
    want = F.when(F.col("set") == "real", F.col("record_id")).otherwise(F.col("id"))
    c = cases.select(F.col("id").alias("case_id"), F.col("record_id").alias("case_record"), "set", "group", "answer", want.alias("match_id"))
    return c.join(flags.select("match_id", "method", "run", "names"), "match_id").withColumn("text_field", F.substring_index("case_record", ":", -1))


def with_key(rows: DataFrame, kind: str, *columns: str) -> DataFrame:
    """rows with the content key of a judgement."""
    return rows.withColumn("key", hashing.sha_key(F.lit(kind), *map(F.col, columns)))


def to_do(jobs: DataFrame, cache: DataFrame) -> DataFrame:
    """One job for each key that the cache does not hold."""
    return jobs.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def fill_cache(jobs: DataFrame, cache: DataFrame, judge: Callable[[pd.DataFrame], pd.Series], field: str, kind: str, seed: int = 0) -> DataFrame:
    """The cache with what is missing judged, in shuffled order; judge gives the field for rows of jobs."""
    todo = sampling.shuffled(to_do(jobs, cache), seed, f"{field}-pool", ["key"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"key": p["key"], field: judge(p)})

    return cache.select("key", field).unionByName(todo.mapInPandas(run, f"key string, {field} {kind}"))


def call_with_retries(call: Callable[[dict], dict], record: dict, attempts: int = ATTEMPTS) -> dict:
    """A log line of calling a checker: up to so many attempts, usage summed over them, failed if none succeeded.

    call returns {"flags": [...], "prompt_tokens", "completion_tokens", "cost"} or raises; StopRun is passed on,
    unless an earlier attempt was billed: then the failed line is returned first with ``stop`` set.
    """
    sums: dict = {}
    why = ""
    for n in range(1, attempts + 1):
        try:
            got = call(record)
        except StopRun as e:
            if sums:
                return {"id": record["id"], "flags": None, "failed": True, "attempts": n, "error": str(e), "stop": True, **sums}
            raise
        except Exception as e:
            got, why = dict(getattr(e, "usage", None) or {}), str(e)
            ok = False
        else:
            ok = isinstance(got.get("flags"), list) and all(isinstance(f, dict) and {"names", "reason"} <= set(f) for f in got["flags"])
            why = "" if ok else "reply does not fit the schema"
        for k in ("prompt_tokens", "completion_tokens", "cached_tokens", "cost"):
            if got.get(k) is not None:
                sums[k] = sums.get(k, 0) + got[k]
        if ok:
            return {"id": record["id"], "flags": got["flags"], "failed": False, "attempts": n, **sums}
    return {"id": record["id"], "flags": None, "failed": True, "attempts": attempts, "error": why, **sums}


def run_checker(records: DataFrame, done: DataFrame | None, call: Callable[[dict], dict]) -> DataFrame:
    """Log lines of the records(id, input) that have no line without failure yet."""
    todo = records if done is None else records.join(done.where("NOT failed").select("id"), "id", "left_anti")
    schema = "id string, flags array<struct<names:string,reason:string>>, failed boolean, attempts int, error string, prompt_tokens long, completion_tokens long, cost double"

    names = ["id", "flags", "failed", "attempts", "error", "prompt_tokens", "completion_tokens", "cost"]
    flag = pa.struct([("names", pa.string()), ("reason", pa.string())])
    types = [pa.string(), pa.list_(flag), pa.bool_(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [call_with_retries(call, r) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    return todo.select("id", "input").mapInArrow(run, schema)


def failed_calls(lines: DataFrame) -> DataFrame:
    """(method, run, records, failed, warn) by the last line of each id."""
    last = last_per_key(lines.select("method", "run", "id", "pos", "failed"), ["method", "run", "id"], ["pos"])
    g = last.groupBy("method", "run").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.coalesce("failed", F.lit(False))).alias("failed"))
    return g.withColumn("warn", F.col("failed") > MOST_FAILED * F.col("records"))


def judged(cases: DataFrame, flags: DataFrame, runs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(case_id, set, group, method, votes, runs, caught): a case is caught in a run if any of its flags is a catch,
    and by a method in a strict majority of its runs(method, run); verdicts is the cache (key, catch)."""
    hits = with_key(on_cases(cases, flags), "catch", "answer", "case_record", "text_field", "names").join(verdicts, "key")
    per_run = aggregates.any_match(hits, ["case_id", "method", "run"], F.col("catch"), "hit")
    # a handful of runs, as a literal beside every case
    known = sorted((r["method"], r["run"]) for r in runs.select("method", "run").distinct().limit(MOST_RUNS + 1).collect())
    if len(known) > MOST_RUNS:
        raise ValueError(f"over {MOST_RUNS} runs")
    each = F.array(*(F.struct(F.lit(m).alias("method"), F.lit(r).alias("run")) for m, r in known)).cast("array<struct<method:string,run:int>>")
    grid = cases.select(F.col("id").alias("case_id"), "set", "group", F.explode(each).alias("_r")).select("case_id", "set", "group", "_r.method", "_r.run")
    full = grid.join(per_run, ["case_id", "method", "run"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return aggregates.majority(full, ["case_id", "set", "group", "method"], "hit")


def paired_tests(results: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(test, both, only_a, only_b, neither, p, significant) of pairs of methods over the cases that both have."""
    out = None
    for name, (a, b) in pairs.items():
        side = lambda m, n: results.where(F.col("method") == m).select("case_id", F.col("caught").alias(n))
        row = aggregates.contingency(side(a, "a").join(side(b, "b"), "case_id"), F.col("a"), F.col("b")).select(F.lit(name).alias("test"), "*")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("significant", (F.col("p") < 0.05) & (F.col("only_a") > F.col("only_b")))


def sweep_sample(flags: DataFrame, size: int, seed: int) -> DataFrame:
    """At most so many flags of the first run of each method, by hash."""
    first = flags.where("run = 1").select("method", "id", "names").withColumn("key", hashing.sha_key(F.lit("label"), F.col("id"), F.col("names")))
    return sampling.sample(first, size, seed, "label-draw", ["method", "id", "names"], ["method"])


def false_alarms(drawn: DataFrame, labels: DataFrame, flags: DataFrame, records: int) -> DataFrame:
    """Precision of each method's drawn flags under labels (key, label), and its flags on 1000 records."""
    got = drawn.join(labels, "key")
    total = flags.where("run = 1").groupBy("method").agg(F.count(F.lit(1)).alias("flags"))
    p = aggregates.precision(got.withColumn("_n", F.lit(records)), ["method"], "label", F.col("_n"), right="real_mismatch", unsure="cant_tell").drop("per_1000")
    per = F.round(1000 * F.col("flags") / records, 6) if records else F.lit(None).cast("double")
    return p.join(total, "method").withColumn("flags_per_1000", per)


def report(results: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> dict[str, DataFrame]:
    """Tests over planted cases and recall by method and group, with intervals, of planted and real ones."""
    planted = results.where("set = 'planted'")
    recall = lambda d: aggregates.recall(d, ["method", "group"], F.col("caught"), interval=True).where("method IS NOT NULL")
    return {"tests": paired_tests(planted, pairs), "planted_recall": recall(planted), "real_recall": recall(results.where("set = 'real'"))}


def spot_check(items: DataFrame, size: int, seed: int) -> DataFrame:
    """Rows(check, key, verdict) to review by hand: so many of each check."""
    return sampling.sample(items, size, seed, "spot", ["check", "key"], ["check"]).withColumn("author", F.lit(""))


def spot_score(items: DataFrame, filled: DataFrame) -> DataFrame:
    """(check, agree, n, share) of the filled rows (author not blank): catch by yes or no, labels by name."""
    said = F.lower(F.trim("author"))
    f = filled.where(said != "").select("check", "key", said.alias("said"))
    j = f.join(items.select("check", "key", F.lower(F.col("verdict")).alias("v")), ["check", "key"])
    agree = F.when(F.col("check") == "catch", (F.col("said") == "yes") == (F.col("v") == "true")).otherwise(F.col("said") == F.col("v"))
    return j.groupBy("check").agg(F.count_if(agree).alias("agree"), F.count(F.lit(1)).alias("n")).withColumn("share", F.col("agree") / F.col("n"))


def as_text(recall: DataFrame) -> str:
    """A plain table of recall rows."""
    rows = recall.orderBy("method", F.col("group").isNotNull(), "group").collect()
    pct = lambda x: "-" if x is None else f"{100 * x:.1f} %"
    return "\n".join(f"{r['method']:<12} {r['group'] or 'all':<14} {r['k']:>5} / {r['n']:<5} {pct(r['share']):>8}  [{pct(r['ci']['lo'])}, {pct(r['ci']['hi'])}]" for r in rows)


def settings_grid(settings: Sequence[dict], records: DataFrame) -> DataFrame:
    """Every record under every setting of a short list."""
    grid = F.array(*(F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in s.items()))) for s in settings))
    return records.select("*", F.posexplode(grid).alias("setting_no", "setting"))


