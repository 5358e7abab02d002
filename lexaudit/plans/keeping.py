"""Queries over tables that are published, kept up to date and gathered while they are written, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexaudit.operators import upkeep
from lexaudit.sources import files
from lexaudit.sources.publish import Conflict, Published
from lexaudit.sources.shared import scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- publication ------------------------------------------------------------------------------------


@query("""SELECT 'orders' AS "table", 2 AS version, o_orderkey AS key, o_totalprice + 1 AS value FROM orders
  UNION ALL SELECT 'lines', 2, l_orderkey, count(*) + 1 FROM lineitem GROUP BY l_orderkey
  UNION ALL SELECT 'orders', 1, o_orderkey, o_totalprice FROM orders UNION ALL SELECT 'lines', 1, l_orderkey, count(*) FROM lineitem GROUP BY l_orderkey
  UNION ALL SELECT 'refused', v, NULL, NULL FROM (VALUES (1), (2)) AS x(v)""")
def published_records(spark, d):
    """Orders and counts of their lines, published together: a job that fails midway and a writer that comes second change nothing."""
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"))
    lines = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    store = Published(spark, scratch(spark, "published"), "json")
    first = store.publish({"orders": orders, "lines": lines}, {"by": "first"})
    failed = []
    fails = F.when(F.col("key") % 7 == 3, F.raise_error(F.lit("this job fails"))).otherwise(F.col("value"))
    try:
        store.publish({"orders": orders.withColumn("value", F.col("value") + 5), "lines": lines.withColumn("value", fails.cast("double"))})
    except Exception:  # whatever ends a job midway
        failed.append(store.version())
    more = lambda df: df.withColumn("value", F.col("value") + 1)
    second = store.publish({"orders": more(orders), "lines": more(lines)}, based_on=first)
    try:
        store.publish({"orders": orders.limit(0), "lines": lines.limit(0)}, based_on=first)
    except Conflict:
        failed.append(store.version())
    out = spark.createDataFrame([("refused", v, None, None) for v in failed], "`table` string, version int, key long, value double")
    for version in (first, second):
        for name in ("orders", "lines"):
            out = out.unionByName(store.read(name, version).select(F.lit(name).alias("table"), F.lit(version).alias("version"), "key", "value"))
    return out


# -- what is computed again after a change ----------------------------------------------------------

MONTH = "1995-03"

_VALUES = f"""l AS (SELECT l_orderkey AS o, l_linenumber AS n, sum(round(l_extendedprice * 100) * (100 - round(l_discount * 100))) AS price, max(round(l_tax * 100)) AS tax FROM lineitem GROUP BY ALL),
e AS (SELECT strftime(o_orderdate, '%Y-%m') AS part, o, n, price * CASE WHEN strftime(o_orderdate, '%Y-%m') = '{MONTH}' AND o % 3 = 0 AND n = 1 THEN 2 ELSE 1 END AS price, tax FROM l JOIN orders ON o_orderkey = o),
g AS (SELECT part, o, sum(price) AS net, sum(price * tax) AS due FROM e GROUP BY ALL),
v AS (SELECT part, o, 'line:' || n AS name, price AS value FROM e UNION ALL SELECT part, o, 'tax:' || n, price * tax FROM e UNION ALL SELECT part, o, 'net', net FROM g
  UNION ALL SELECT part, o, 'charge', 100 * net + due FROM g UNION ALL SELECT part, o, 'bonus', 2 * (100 * net + due) + 5 FROM g)"""


def order_terms(spark: SparkSession, d: str) -> DataFrame:
    """What each order's values read, in whole hundredths: lines, the tax on them, their sum, the charge and a bonus on it."""
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("group"), F.date_format("o_orderdate", "yyyy-MM").alias("part"))
    price = F.sum(F.round(F.col("l_extendedprice") * 100) * (100 - F.round(F.col("l_discount") * 100)))
    # all of an order's lines are in one task from here on; its first line brings the terms of the order
    lines = t(spark, d, "lineitem").withColumn("group", F.col("l_orderkey")).repartition("group").groupBy("group", F.col("l_linenumber").alias("n"))
    lines = lines.agg(price.alias("price"), F.max(F.round(F.col("l_tax") * 100)).alias("tax")).join(orders, "group")
    lines = lines.withColumn("first", F.row_number().over(Window.partitionBy("part", "group").orderBy("n")) == 1)
    line, tax = F.concat(F.lit("line:"), "n"), F.concat(F.lit("tax:"), "n")
    row = lambda name, reads, coef: F.struct(name.alias("name"), reads.cast("string").alias("reads"), coef.cast("double").alias("coef"))
    lit = F.lit
    each = F.array(row(line, lit(None), F.col("price")), row(tax, line, F.col("tax")), row(lit("net"), line, lit(1)), row(lit("charge"), tax, lit(1)))
    once = F.array(row(lit("charge"), lit("net"), lit(100)), row(lit("bonus"), lit("charge"), lit(2)), row(lit("bonus"), lit(None), lit(5)))
    return lines.select("part", "group", F.explode(F.when(F.col("first"), F.concat(each, once)).otherwise(each)).alias("t")).select("part", "group", "t.*")


def doubled_lines(terms: DataFrame) -> DataFrame:
    """The changes of reevaluated_orders: the first line of every third order of a month counts twice."""
    return terms.where((F.col("part") == MONTH) & (F.col("group") % 3 == 0) & (F.col("name") == "line:1")).withColumn("coef", F.col("coef") * 2)


@query(f"""WITH {_VALUES} SELECT part, o AS "group", name, value FROM v""")
def reevaluated_orders(spark, d):
    """All values of all orders after some lines changed: only what reads them is computed again, in their month alone."""
    store = Published(spark, scratch(spark, "upkeep"))
    terms = order_terms(spark, d)
    upkeep.create(store, terms)
    upkeep.apply_edits(store, doubled_lines(store.read("terms")))
    return store.read("results").select("part", "group", "name", "value")


# -- gathered while rows are written ----------------------------------------------------------------


@query("""SELECT "counter", n FROM (UNPIVOT (SELECT count(*) AS rows, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_discount > 0.05) AS reduced,
  count(*) FILTER (l_quantity >= 45) AS large, max(l_linenumber)::BIGINT AS most_lines FROM lineitem) ON rows, returned, reduced, large, most_lines INTO NAME "counter" VALUE n)
  UNION ALL SELECT 'written', count(*) FROM lineitem""")
def counted_lines(spark, d):
    """Lines of orders are written and counted in one job: the counters, and how many rows are in what was written."""
    at = scratch(spark, "counted")
    counters = {"rows": F.count(F.lit(1)), "returned": F.count_if(F.col("l_returnflag") == "R"), "reduced": F.count_if(F.col("l_discount") > 0.05), "large": F.count_if(F.col("l_quantity") >= 45), "most_lines": F.max("l_linenumber")}
    found = files.write_counted(t(spark, d, "lineitem"), lambda df: df.write.parquet(at), counters)
    told = spark.createDataFrame([(k, int(v)) for k, v in found.items()], "counter string, n long")
    return told.unionByName(spark.read.parquet(at).agg(F.count(F.lit(1)).alias("n")).select(F.lit("written").alias("counter"), "n"))


_LINE = "CASE o_orderkey % 97 WHEN 0 THEN '{\"key\":' || o_orderkey || ',\"st' WHEN 1 THEN '{\"key\":\"x\",\"status\":\"' || o_orderstatus || '\"}' WHEN 2 THEN '  ' WHEN 3 THEN '[' || o_orderkey || ']' ELSE '{\"key\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}' END"


@query(f"""WITH x AS (SELECT o_custkey % 5 AS folder, o_orderkey AS k, {_LINE} AS text, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) AS line, o_orderstatus AS s FROM orders)
SELECT 'bad' AS what, folder::BIGINT AS folder, line AS line, text FROM x WHERE k % 97 IN (0, 1, 3) UNION ALL SELECT 'good', NULL, k, s FROM x WHERE k % 97 > 3""")
def quarantined_lines(spark, d):
    """Orders as JSON lines, some of them broken: good rows on one side, bad ones with their file and line on the other."""
    at = scratch(spark, "lines")
    rows = t(spark, d, "orders").select((F.col("o_custkey") % 5).alias("folder"), "o_orderkey", F.expr(_LINE).alias("value"))
    rows.repartition("folder").sortWithinPartitions("folder", "o_orderkey").select("folder", "value").write.partitionBy("folder").text(at)
    good, bad = files.readable_lines(spark, f"{at}/*", StructType.fromDDL("key long, status string"))
    bad = bad.select(F.lit("bad").alias("what"), F.regexp_extract("file", "folder=([0-9]+)", 1).cast("long").alias("folder"), "line", "text")
    return bad.unionByName(good.select(F.lit("good").alias("what"), F.lit(None).cast("long").alias("folder"), F.col("key").alias("line"), F.col("status").alias("text")))
