"""Named queries of the scoring, injection, expression and page operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.operators import expr, inject, sampling, versions
from lexaudit.sources import pages

def _cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


def inject_scale(spark: SparkSession, d: str) -> DataFrame:
    """Retail prices in cents changed by each ratio factor that keeps whole cents, with the hash of the changed row."""
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (_cents("p_retailprice") / 100).alias("price"))
    x = inject.ratio_plans(p, "price")
    cents = F.round(F.col("new_value") * 100).cast("long")
    return x.select("p_partkey", "factor", cents.alias("cents"), inject.content_hash(F.concat_ws(":", "p_partkey", cents)).alias("sha"))


INJECT_SCALE = """SELECT p_partkey, f::DOUBLE AS factor, round(c * f)::BIGINT AS cents, sha256(p_partkey || ':' || round(c * f)::BIGINT) AS sha
  FROM (SELECT p_partkey, round(p_retailprice * 100)::BIGINT AS c FROM part), (VALUES (0.5), (0.75), (1.5), (2.0)) AS v(f) WHERE abs(c * f - round(c * f)) < 1e-6"""


def inject_drop(spark: SparkSession, d: str) -> DataFrame:
    """Words of part names with each one dropped in turn."""
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.split("p_name", " ").alias("words"))
    return inject.drop_plans(p, "words").select("p_partkey", "dropped", F.array_join("new_parts", " ").alias("text"))


INJECT_DROP = """SELECT p_partkey, (i - 1)::INT AS dropped, array_to_string(list_concat(w[: i - 1], w[i + 1 :]), ' ') AS text
  FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), unnest(range(1, len(w) + 1)) AS u(i) WHERE len(w) >= 2"""


def reverify_hash(spark: SparkSession, d: str) -> DataFrame:
    """Orders made again at another price where urgent: which do not give the manifest's hash back."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", _cents("o_totalprice").alias("c"), "o_orderpriority")
    doc = lambda c: F.concat_ws(":", "o_orderkey", c)
    manifest = o.select(F.col("o_orderkey").alias("id"), inject.content_hash(doc(F.col("c"))).alias("sha256"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    again = o.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("id"), doc(F.when(urgent, F.col("c") + 1).otherwise(F.col("c"))).alias("input"))
    return inject.verify(manifest, again)


REVERIFY = """SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'different content' ELSE 'missing' END AS problem FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')"""


def multiplier_plans(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_size").cast("double").alias("m"))
    return inject.multiplier_plans(p, "m").select("p_partkey", "new_value")


MULTIPLIER = """SELECT p_partkey, v::DOUBLE AS new_value FROM (SELECT p_partkey, p_size AS m, unnest([p_size + 1, p_size - 1]) AS v FROM part) WHERE m NOT IN (0, 1, 100, 1000, -1) AND v >= 1 AND v NOT IN (0, 1, 100, 1000, -1)"""


def draw_numbers(spark: SparkSession, d: str) -> DataFrame:
    """All suppliers numbered in hash order."""
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("record_id"))
    return inject.numbered_set(s, "s", 7)


NUMBERS = """SELECT s_suppkey AS record_id, 's-' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') AS id FROM (SELECT s_suppkey, row_number() OVER (ORDER BY md5('7:number:' || s_suppkey), s_suppkey) AS n FROM supplier)"""


def shuffled_pool(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey")
    return c.select("c_custkey", sampling.draw_key(7, "pool", F.col("c_custkey")).alias("place"))


SHUFFLED = "SELECT c_custkey, md5('7:pool:' || c_custkey) AS place FROM customer"


def version_map(spark: SparkSession, d: str) -> DataFrame:
    """Order years and months as notes names (last two digits of the year), mapped to quarterly folders."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.format_string("%d.%d", (F.year("o_orderdate") % 100).cast("int"), F.month("o_orderdate")).alias("name")).distinct()
    return versions.map_notes(o, "name", FOLDERS).select("name", "shipped", "before")


FOLDERS = [f"{y}.{m}" for y in (80, 85, 90) for m in (1, 4, 7, 10)]
VERSION_MAP = f"""WITH n AS (SELECT DISTINCT (year(o_orderdate) % 100)::VARCHAR || '.' || month(o_orderdate) AS name, year(o_orderdate) % 100 AS y0, month(o_orderdate) AS m FROM orders),
  k AS (SELECT name, (CASE WHEN y0 >= 25 THEN y0 - 10 ELSE y0 END) * 100000 + m AS k FROM n),
  f AS (SELECT f, split_part(f, '.', 1)::BIGINT * 100000 + split_part(f, '.', 2)::BIGINT AS v FROM (SELECT unnest({FOLDERS}) AS f)),
  s AS (SELECT name, k, min(v) FILTER (v >= k) AS sv FROM k, f GROUP BY name, k)
  SELECT name, (SELECT f FROM f WHERE v = sv) AS shipped, (SELECT max_by(f, v) FROM f WHERE sv IS NULL OR v < sv) AS before FROM s"""


def expr_eval(spark: SparkSession, d: str) -> DataFrame:
    """Each part as a spell whose damage is its size by rank plus a share of a stat: what its token shows."""
    p = spark.read.parquet(f"{d}/part.parquet")
    values = F.array(*(F.col("p_size").cast("double") * r for r in range(7)))
    formula = F.array(
        F.to_json(F.struct(F.lit("NamedDataValueCalculationPart").alias("__type"), F.lit("Base").alias("mDataValue"))),
        F.to_json(F.struct(F.lit("StatByCoefficientCalculationPart").alias("__type"), (F.col("p_retailprice") / 1000).alias("mCoefficient"))),
    )
    spell = F.concat(F.lit('{"mSpell":{"DataValues":[{"name":"Base","values":'), F.to_json(values), F.lit('}],"mSpellCalculations":{"Total":{"__type":"GameCalculation","mFormulaParts":['), F.array_join(formula, ","), F.lit("]}}}}"))
    return expr.resolve_tokens(p.select(F.col("p_partkey").alias("id"), spell.alias("spell"), F.lit("Total").alias("token")), {0: "AP"}).select("id", "kind", "status", F.element_at("base", 1).alias("base"))


EXPR = "SELECT p_partkey AS id, 'calculation' AS kind, 'resolved' AS status, p_size::DOUBLE AS base FROM part"


def html_lines_with_context(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_lines(spark.read.parquet(f"{d}/pages.parquet"))


QUERIES = {f.__name__: f for f in (inject_scale, inject_drop, reverify_hash, multiplier_plans, draw_numbers, shuffled_pool, version_map, expr_eval, html_lines_with_context)}
SQL = {"inject_scale": INJECT_SCALE, "inject_drop": INJECT_DROP, "reverify_hash": REVERIFY, "multiplier_plans": MULTIPLIER, "draw_numbers": NUMBERS, "shuffled_pool": SHUFFLED, "version_map": VERSION_MAP, "expr_eval": EXPR}
