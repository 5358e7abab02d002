"""Queries that run single functions and operators of the library on rows of the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.functions import numeric, text
from lexaudit.operators import expr, graph, inject, sampling, versions

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


@query("""SELECT p_partkey, p_brand || ',b' AS included, p_brand AS read, p_name AS plain, p_name AS file, '@' || p_brand || '@ or @' || p_brand || '@.' AS renamed,
  lower(split_part(p_name, ' ', 2)) AS after, regexp_replace(regexp_replace(printf('%.2f', p_retailprice), '0+$', ''), '\\.$', '') AS price, substr(p_name, 2, 9) AS near,
  'Brand#' AS stem, regexp_extract(p_brand, '([0-9]+)$', 1)::INT AS number, true AS starts, false AS inside,
  lower(split_part(p_name, ' ', 1)) = lower(p_name) OR length(split_part(p_name, ' ', 1)) >= 4 AS linked, p_type || '/' || p_brand || ' (+5% AP)' AS joined, CASE WHEN p_size % 2 = 0 THEN p_size END AS same, 'Cost' AS field
  FROM part""")
def text_edits(spark, d):
    """Includes, names of tokens, renaming at offsets, words after and around a place, fixed decimals, name links, joined displays."""
    c, lit = F.col, F.lit
    first = F.substring_index("p_name", " ", 1)
    template = lit("@A.1@ or @spell.B:C@.")
    split = text.split_rank(c("p_brand"))
    return t(spark, d, "part").select(
        "p_partkey",
        F.array_join(text.includes(F.concat(lit("{{ "), "p_brand", lit(" }} and {{b}}"))), ",").alias("included"),
        text.token_name(F.concat(lit("spell.Own:"), "p_brand", lit("*100"))).alias("read"),
        text.plain_name(F.concat(c("p_name"), lit(".2"))).alias("plain"),
        text.path_name(F.concat(lit("a/b/"), "p_name")).alias("file"),
        text.rename_tokens(template, text.tokens_with_offsets(template), c("p_brand")).alias("renamed"),
        text.word_after(c("p_name"), F.length(first)).alias("after"),
        text.fixed(c("p_retailprice"), 2).alias("price"),
        text.around(c("p_name"), lit(5), lit(6), 4).alias("near"),
        split["name"].alias("stem"), split["rank"].alias("number"),
        text.name_continues(F.concat(first, lit("_x")), first).alias("starts"),
        text.name_continues(F.concat(first, lit("x")), first).alias("inside"),
        text.name_link(first, c("p_name")).alias("linked"),
        text.per_rank_joined(F.array(F.concat("p_type", lit(" (+5% AP)")), F.concat("p_brand", lit(" (+5% AP)")))).alias("joined"),
        text.once(F.array("p_size", c("p_size") + c("p_size") % 2)).alias("same"),
        text.short_key(lit("mCost"), {"mOther": "x"}).alias("field"),
    )


@query("""SELECT p_partkey, CASE WHEN p = floor(p) THEN 0 WHEN p * 10 = floor(p * 10) THEN 1 ELSE 2 END::INT AS places, least(s, 3)::DOUBLE AS last, s = 25 OR s = 30 AS ranks_agree,
  (s + 0.5)::DOUBLE AS tidy, s % 2 = 0 AS close_ FROM (SELECT p_partkey, round(p_retailprice * 100)::BIGINT / 100 AS p, p_size AS s FROM part)""")
def numbers_by_rank(spark, d):
    """Decimals, the last rank that stands for later ones, agreement of ranks at any scale, and closeness."""
    s = F.col("p_size").cast("double")
    ranks = F.array(F.lit(None).cast("double"), F.least(s, F.lit(3.0)))
    agree = numeric.same_ranks(F.array(s), F.array(F.lit(25.0), F.lit(25.0))) | numeric.same_ranks(F.array(s / 100, F.lit(0.5)), F.array(F.lit(30.0), F.lit(50.0)))
    return t(spark, d, "part").select(
        "p_partkey", numeric.decimals(F.round("p_retailprice", 2)).alias("places"), numeric.ranked(ranks, F.lit(4)).alias("last"), agree.alias("ranks_agree"),
        numeric.clean(s + 0.50000001).alias("tidy"), numeric.close(s, s + F.when(s % 2 == 0, 1e-9).otherwise(0.1)).alias("close_"),
    )


@query("""SELECT l_orderkey AS form, term, round(sum(coef), 6) AS coef FROM (SELECT l_orderkey, l_returnflag AS term, l_discount * 0.5 AS coef FROM lineitem UNION ALL SELECT l_orderkey, l_linestatus, l_tax * 2 FROM lineitem) GROUP BY 1, 2""")
def forms_added(spark, d):
    """Sums of linear forms: one form an order."""
    li = t(spark, d, "lineitem")
    a = li.select(F.col("l_orderkey").alias("form"), F.col("l_returnflag").alias("term"), (F.col("l_discount") * 0.5).alias("coef"))
    b = li.select(F.col("l_orderkey").alias("form"), F.col("l_linestatus").alias("term"), (F.col("l_tax") * 2).alias("coef"))
    return expr.add_forms(a, b).withColumn("coef", F.round("coef", 6))


@query("""SELECT p_partkey AS form, term, CASE WHEN k = 2 THEN NULL ELSE round(coef * (p_size + 1), 6) END AS coef, CASE WHEN k = 2 THEN 'nonlinear: product of two scaling values' END AS problem
  FROM (SELECT p_partkey, p_partkey % 3 AS k, p_size, unnest([NULL, 'AP']) AS term, unnest([10.0, 0.5])::DOUBLE AS coef FROM part) WHERE k <> 2 OR term IS NULL""")
def forms_multiplied(spark, d):
    """Products of linear forms: by a constant on either side, or refused."""
    p = t(spark, d, "part").withColumn("k", F.col("p_partkey") % 3)
    scaling = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(10.0).alias("coef")), F.struct(F.lit("AP").alias("term"), F.lit(0.5).alias("coef")))
    bare = F.array(F.struct(F.lit(None).cast("string").alias("term"), (F.col("p_size") + 1).cast("double").alias("coef")))
    side = lambda has: p.select(F.col("p_partkey").alias("form"), F.explode(F.when(has, scaling).otherwise(bare)).alias("x")).select("form", "x.*")
    return expr.multiply_forms(side(F.col("k") != 1), side(F.col("k") != 0)).withColumn("coef", F.round("coef", 6))


STARTS = [("1992.1", "first"), ("1995.6", "second"), ("1998.1", "third"), ("1998.10", "fourth")]


@query("""SELECT CASE WHEN v >= 199810 THEN 'fourth' WHEN v >= 199801 THEN 'third' WHEN v >= 199506 THEN 'second' WHEN v >= 199201 THEN 'first' END AS layout, count(*) AS n
  FROM (SELECT year(l_shipdate) * 100 + month(l_shipdate) AS v FROM lineitem) GROUP BY 1""")
def layout_by_version(spark, d):
    """The layout that holds from a version on, where versions sort by number (1998.10 is after 1998.9)."""
    v = F.concat_ws(".", F.year("l_shipdate"), F.month("l_shipdate"))
    return t(spark, d, "lineitem").select(versions.layout_of(v, STARTS).alias("layout")).groupBy("layout").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT o_custkey, year(o_orderdate) || '.' || month(o_orderdate) AS version, year(o_orderdate) * 100000 + month(o_orderdate) AS n, min(o_orderkey) AS value FROM orders GROUP BY ALL)
  SELECT o_custkey, version, lead(version) OVER w AS found_version, lead(value) OVER w AS found FROM v WINDOW w AS (PARTITION BY o_custkey ORDER BY n)""")
def first_later_order(spark, d):
    """For each customer and month with an order, the first later month with one and its first order."""
    v = F.concat_ws(".", F.year("o_orderdate"), F.month("o_orderdate")).alias("version")
    months = t(spark, d, "orders").groupBy("o_custkey", v).agg(F.min("o_orderkey").alias("value"))
    return versions.first_later(months.select("o_custkey", "version"), months, "o_custkey", "version")


@query("""WITH n AS (SELECT r_name AS folder, n_nationkey AS k, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey),
  e AS (SELECT a.folder, a.name AS a, b.name AS b FROM n a JOIN n b ON b.k = (a.k * 2) % 25 AND b.folder = a.folder AND b.name <> a.name)
  SELECT folder, a, b FROM e UNION SELECT folder, b, a FROM e""")
def named_links(spark, d):
    """Links between nations whose object names another of the same region, as entries of a folder."""
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("folder"), F.col("n_nationkey").alias("k"), F.col("n_name").alias("path"))
    other = n.select(F.col("k").alias("next"), F.upper("path").alias("other"))
    own = n.withColumn("next", F.col("k") * 2 % 25).join(other, "next")
    obj = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("other").alias("mSpellName"))).alias("parts")).alias("mSpell"), F.col("path").alias("mScriptName")))
    return graph.links(graph.strings_of(own.select("folder", "path", obj.alias("obj"))), n.select("folder", F.col("path").alias("name"), "path"))


@query("""SELECT rule, id FROM (SELECT r_name AS rule, n_name AS id, row_number() OVER (PARTITION BY r_name ORDER BY md5('7:' || r_name || ':' || n_name)) AS k, dense_rank() OVER (ORDER BY r_name) AS i
  FROM nation JOIN region ON n_regionkey = r_regionkey) WHERE k <= 12 // 5 + CASE WHEN i <= 12 % 5 THEN 1 ELSE 0 END""")
def quota_of_nations(spark, d):
    """Twelve nations drawn in turn from the regions, a near-equal quota each."""
    rows = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("rule"), F.col("n_name").alias("id"), F.col("n_nationkey").alias("ability"), F.col("n_name").alias("text"))
    return sampling.draw_by_quota(rows, 12, seed=7)[0].select("rule", "id")


@query("""SELECT rule, id FROM (SELECT o_orderpriority AS rule, o_orderkey::VARCHAR AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('7:' || o_orderpriority || ':' || o_orderkey)) AS k, dense_rank() OVER (ORDER BY o_orderpriority) AS i FROM orders)
  WHERE k <= 33 // 5 + CASE WHEN i <= 33 % 5 THEN 1 ELSE 0 END""")
def quota_of_orders(spark, d):
    """Orders drawn in turn by priority, each with an ability and a text of its own; the driver gets what can be drawn, not the table."""
    o = t(spark, d, "orders")
    rows = o.select(F.col("o_orderpriority").alias("rule"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("ability"), F.concat(F.lit("t"), "o_orderkey").alias("text"))
    return sampling.draw_by_quota(rows, 33, seed=7)[0].select("rule", "id")


@query("""SELECT c_custkey FROM customer ORDER BY md5('7:pool:' || c_custkey), c_custkey""")
def shuffled_customers(spark, d):
    return sampling.shuffled(t(spark, d, "customer").select("c_custkey"), 7, "pool", ["c_custkey"])


@query("""SELECT p_partkey, '{"name":"' || p_name || '","ranks":[' || p_size || CASE WHEN p_partkey % 2 = 0 THEN ',7' ELSE '' END || ']}' AS changed FROM part""")
def changed_documents(spark, d):
    """Documents with the value at a path replaced, or an element of a list left out."""
    even = F.col("p_partkey") % 2 == 0
    doc = F.to_json(F.struct(F.array("p_size", F.lit(5)).alias("ranks"), F.col("p_name").alias("name")))
    rows = t(spark, d, "part").select("p_partkey", doc.alias("doc"), F.lit('["ranks",1]').alias("path"), F.when(even, "7").alias("value"))
    return inject.apply_changes(rows).select("p_partkey", "changed")


_FLAWS = ["resolved", "text", "input", "shape", "data", "others", "level_up", "shown", "base", "dropped", "anchored", None]


@query(f"""SELECT p_partkey, problem FROM part JOIN (SELECT unnest(range(0, {len(_FLAWS)})) AS c, unnest([{", ".join(f"'{x}'" for x in inject.CHECKS)}, NULL]) AS problem) ON c = p_partkey % {len(_FLAWS)}""")
def planted_problems(spark, d):
    """Planted errors with one flaw each: the invariant that refuses them."""
    flaw = F.element_at(F.array(*(F.lit(x).cast("string") for x in _FLAWS)), (F.col("p_partkey") % len(_FLAWS) + 1).cast("int"))
    has = lambda x: F.coalesce(flaw == x, F.lit(False))
    numbers = F.when(has("base"), F.array(F.lit(-1.0))).when(has("dropped"), F.array(F.lit(0.0))).otherwise(F.array(F.lit(2.0)))
    rows = t(spark, d, "part").select(
        "p_partkey", (~has("resolved")).alias("resolved"), F.col("p_name").alias("text"), F.when(has("text"), "another").otherwise(F.col("p_name")).alias("planned_text"),
        F.when(has("input"), F.col("p_brand")).otherwise("new").alias("input"), F.col("p_brand").alias("original"), F.lit(True).alias("id_same"), F.lit("a").alias("shape"),
        F.when(has("shape"), "b").otherwise("a").alias("planned_shape"), (~has("data")).alias("data_same"), F.lit(True).alias("is_text"), (~has("others")).alias("others_same"),
        (~has("level_up")).alias("level_up_same"), F.when(~has("shown"), "3").alias("shown"), F.lit("2").alias("shown_before"), numbers.alias("base"), F.array(F.lit(2.0)).alias("base_before"),
        F.lit(True).alias("dropped"), F.lit(False).alias("has_scalings"), (~has("anchored")).alias("anchored"),
    )
    return inject.self_check(rows).select("p_partkey", "problem")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '@' || p_name || '@ scales with a ratio of 0.6 instead of 0.5; it disagrees with ' || p_brand || '.'
  WHEN 1 THEN '@' || p_name || '@ lacks the term 0.5; it disagrees with ' || p_brand || '.' ELSE 'the text shows @0.6@ where it should show @0.5@; it disagrees with ' || p_brand || '.' END AS answer FROM part""")
def answers(spark, d):
    rule = F.element_at(F.array(*map(F.lit, ["stat_ratio", "drop_term", "other_value"])), (F.col("p_partkey") % 3 + 1).cast("int"))
    return t(spark, d, "part").select("p_partkey", inject.answer(rule, F.col("p_name"), F.lit("0.5"), F.lit("0.6"), F.col("p_brand")).alias("answer"))


@query("""SELECT DISTINCT p_partkey AS id, 'size' AS kind, l_orderkey AS "where" FROM part JOIN lineitem ON l_partkey = p_partkey AND abs(p_size - l_quantity) <= 1e-6 * greatest(1, p_size, l_quantity)""")
def size_anchors(spark, d):
    """Orders with a line of a part whose quantity is the part's size: values elsewhere that agree within a millionth."""
    sizes = t(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("v"))
    lines = t(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").cast("double").alias("o"), F.col("l_orderkey").alias("where"))
    return inject.anchors(sizes, lines, "p_partkey", "v", "o", "size")
