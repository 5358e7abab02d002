"""Scans and sinks of JSON lines and CSV: records, items, cases, runs, logs, manifests."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def json_lines(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str | None = None) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped.  Give a schema: inferring one reads everything twice."""
    r = spark.read
    return (r.schema(schema) if schema is not None else r).json(paths if isinstance(paths, str) else list(paths))


def readable_lines(spark: SparkSession, paths: str | Sequence[str], schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of JSON lines: rows of the schema, and (file, line, text) of lines that are none.

    A line is bad if it is no JSON object or a field has another type.  Blank lines are skipped but count as
    lines.  A file may be read by many tasks: lines are numbered within the block that a task read, and blocks have their
    first line from a count of those before.
    """
    bad_name = "_unreadable"
    full = StructType([*schema.fields, StructField(bad_name, StringType())])
    m = F.col("_metadata")
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths)).select("value", m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("_at"))
    read = lines.where(F.trim("value") != "").withColumn("_r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad_name}))
    fails = F.col("_r").isNull() | F.col(f"_r.{bad_name}").isNotNull() | ~F.ltrim("value").startswith("{")
    good = read.where(~fails).select("_r.*").drop(bad_name)
    blocks = lines.groupBy("file", "block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("_before", F.coalesce(before, F.lit(0)))
    bad = read.where(fails).join(blocks, ["file", "block"]).select("file", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line"), F.col("value").alias("text"))
    return good, bad


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def unwrapped(df: DataFrame, inner: str = "input", tag: str = "kind") -> DataFrame:
    """(item, input) of lines that either are an input or wrap one: wrapped where both fields are there."""
    has = {c.lower() for c in df.columns}
    if inner not in has or tag not in has:
        return df.select(F.lit(None).cast("string").alias("item"), F.to_json(F.struct("*")).alias("input"))
    wrapped = F.col(inner).isNotNull() & F.col(tag).isNotNull()
    own = [c for c in df.columns if c != inner]
    return df.select(F.when(wrapped, F.to_json(F.struct(*own))).alias("item"), F.when(wrapped, F.to_json(inner)).otherwise(F.to_json(F.struct("*"))).alias("input"))


def records(df: DataFrame, inner: str = "input") -> DataFrame:
    """(id, input) of lines; the id of a wrapping line wins over that of its input."""
    if inner not in df.columns:
        return df.select("id", F.to_json(F.struct("*")).alias("input"))
    bare = F.to_json(F.struct(*(c for c in df.columns if c != inner)))
    return df.select(F.coalesce(F.col("id"), F.get_json_object(F.to_json(inner), "$.id")).alias("id"), F.when(F.col(inner).isNotNull(), F.to_json(inner)).otherwise(bare).alias("input"))


def record_pair(spark: SparkSession, folder: str, patch: str, locale: str, make: str) -> tuple[DataFrame, DataFrame]:
    """Records and spell lines of a version and language; names the command that makes them if a file is missing."""
    paths = [f"{folder}/{patch}.{locale}.jsonl", f"{folder}/{patch}.{locale}.spells.jsonl"]
    for p in paths:
        if not exists(spark, p):
            raise FileNotFoundError(f"{p} is missing; make it with: {make}")
    return json_lines(spark, paths[0]), json_lines(spark, paths[1])


def confirmed(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a reviewed CSV whose status is confirmed."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).where("status = 'confirmed'")


def composite_id(*parts: str) -> Column:
    """Parts joined by colons; a null part reads None."""
    return F.concat_ws(":", *(F.coalesce(F.col(p).cast("string"), F.lit("None")) for p in parts))


def cases(spark: SparkSession, path: str) -> DataFrame:
    """(id, record_id, set, group, answer) from a reviewed CSV (real cases) or JSON lines (planted ones)."""
    if path.endswith(".csv"):
        c = confirmed(spark, path)
        rid = composite_id("prefix_patch", "locale", "champion_folder", "spell_path", "text_field")
        answer = F.format_string("The text says: %s The data says: %s Reason: %s", F.coalesce("text_says", F.lit("")), F.coalesce("data_says", F.lit("")), F.coalesce("reason", F.lit("")))
        return c.select(F.col("unit_id").alias("id"), rid.alias("record_id"), F.lit("real").alias("set"), F.col("mechanism").alias("group"), answer.alias("answer"))
    p = json_lines(spark, path, "id string, record_id string, rule string, kind string, answer string")
    return p.select("id", "record_id", F.lit("planted").alias("set"), F.col("rule").alias("group"), "answer")


def runs(spark: SparkSession, methods: Mapping[str, Sequence[str]], schema: StructType | str) -> DataFrame:
    """Log lines of several methods with method, run (from 1) and pos (order in the file), files given by method and run."""
    out = None
    for method, files in methods.items():
        for run, path in enumerate(files, 1):
            one = json_lines(spark, path, schema).select("*", F.lit(method).alias("method"), F.lit(run).alias("run"), F.monotonically_increasing_id().alias("pos"))
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no run was given")
    return out


def method_spec(spec: str) -> tuple[str, list[str]]:
    """``name=file,file`` taken apart."""
    name, eq, files = spec.partition("=")
    if not eq or not name or not files:
        raise ValueError(f"not NAME=FILE[,FILE...]: {spec}")
    return name, [f for f in files.split(",") if f]


# -- sinks ----------------------------------------------------------------------------------------


def write_json_lines(df: DataFrame, path: str, *, one_file: bool = False) -> None:
    """JSON lines without null fields and without columns that start with an underscore; what was there before goes first.

    A job that fails leaves nothing to read.  Where readers must go on with what they had, use ``publish``.
    """
    own = df.drop(*(c for c in df.columns if c.startswith("_")))
    (own.coalesce(1) if one_file else own).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def write_counted(df: DataFrame, write: Callable[[DataFrame], None], counters: Mapping[str, Column]) -> dict:
    """Writes df by ``write`` and returns counters (aggregates over its rows), gathered by the same job.

    A partition that is computed again after a lost executor counts again: counts of a job that had to may
    be too high, and are then to be read from what was written.
    """
    seen = Observation()
    write(df.observe(seen, *(c.alias(name) for name, c in counters.items())))
    return seen.get


def append_log(df: DataFrame, path: str) -> None:
    """Adds lines to a log; readers take the last line of a key."""
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """One CSV with exactly these columns in this order."""
    df.select(*columns).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def compact_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Every row as compact JSON."""
    return df.select(F.to_json(F.struct("*")).alias(name))


def manifest(errors: DataFrame, **facts) -> DataFrame:
    """One row: the facts of a set, the counts by rule and the list of errors by id, as JSON."""
    rows = F.array_sort(F.collect_list(F.struct(*sorted(errors.columns, key=lambda c: c != "id"))))
    # as many counts as there are rules
    counts = errors.groupBy("rule").count().orderBy("rule").collect()
    by_rule = F.create_map(*(F.lit(x) for r in counts for x in r)) if counts else F.create_map().cast("map<string,long>")
    one = errors.agg(F.count(F.lit(1)).alias("count"), rows.alias("errors"))
    return one.select(F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in facts.items()), "count", by_rule.alias("counts"), "errors")).alias("manifest"))
