"""The flagship plan: templated texts are filled from data and what they show is held against a recomputation.

One shuffle each of orders and lineitem on the order key (lineitem after partial aggregation); everything
else is a projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.functions import text

TEMPLATE = "Order @o_orderkey@ totals @o_totalprice@ in @LineCount@ lines, status @o_orderstatus@ @Unknown.1@"


def audit(orders: DataFrame, lines: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """o_orderkey, filled text, number of tokens and of unresolved ones, and the rules that flag the order.

    An order without lines has an unresolved count of lines and is never flagged: a side that cannot be
    computed is not a difference.
    """
    total = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
    per = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"), F.round(total, 2).alias("recomputed"))
    j = orders.join(per, "o_orderkey", "left").withColumn("template", F.lit(template))
    values = F.create_map(
        F.lit("o_orderkey"), F.col("o_orderkey").cast("string"),
        F.lit("o_totalprice"), F.format_string("%.2f", F.col("o_totalprice")),
        F.lit("linecount"), F.col("n_lines").cast("string"),
        F.lit("o_orderstatus"), F.col("o_orderstatus"),
    )
    names = F.transform(text.tokens(F.col("template")), lambda k: F.struct(k.alias("token"), F.element_at(values, F.lower(text.parse_token(k)["name"])).alias("value")))
    j = j.withColumn("found", names)
    shown = F.map_from_entries(F.filter("found", lambda x: x["value"].isNotNull()))
    differs = F.abs(F.col("recomputed") - F.col("o_totalprice")) > 0.01
    rules = F.array_compact(F.array(F.when(differs, F.lit("total")), F.when(F.col("n_lines") > 6, F.lit("many_lines"))))
    return j.select(
        "o_orderkey",
        text.fill(F.col("template"), shown).alias("filled"),
        F.size("found").cast("long").alias("n_tokens"),
        F.size(F.filter("found", lambda x: x["value"].isNull())).cast("long").alias("unresolved"),
        F.array_join(rules, "+").alias("rules"),
    )


def template_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit(spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/lineitem.parquet"))


TEMPLATE_AUDIT_SQL = """
WITH p AS (SELECT l_orderkey AS o_orderkey, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS r FROM lineitem GROUP BY 1)
SELECT o_orderkey, 'Order ' || o_orderkey || ' totals ' || printf('%.2f', o_totalprice) || ' in ' || coalesce(n::VARCHAR, '@LineCount@') || ' lines, status ' || o_orderstatus || ' @Unknown.1@' AS filled,
  5::BIGINT AS n_tokens, (1 + CASE WHEN n IS NULL THEN 1 ELSE 0 END)::BIGINT AS unresolved,
  concat_ws('+', CASE WHEN abs(r - o_totalprice) > 0.01 THEN 'total' END, CASE WHEN n > 6 THEN 'many_lines' END) AS rules
FROM orders LEFT JOIN p USING (o_orderkey)"""

QUERIES = {"template_audit": template_audit}
SQL = {"template_audit": TEMPLATE_AUDIT_SQL}
