"""Named queries of the relational operators and the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.functions import hashing, numeric, text
from lexaudit.operators import aggregates, graph, joins, sampling, setops, windows

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is any."""

    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- windows and order ----------------------------------------------------------------------------


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def last_event_per_user(spark, d):
    return windows.last_per_key(t(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def first_event_per_user_type(spark, d):
    return windows.first_per_key(t(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_position FROM events GROUP BY event_type")
def most_common_events(spark, d):
    return windows.most_common(t(spark, d, "events"), "event_type", "event_id")


@query("""SELECT page_id, version, row_number() OVER (ORDER BY major, minor, page_id) AS place FROM (
  SELECT page_id, length(url) || '.' || n AS version, length(url)::INT AS major, n::INT AS minor
  FROM (SELECT page_id, url, regexp_extract(url, '/([0-9]+)', 1) AS n FROM pages) WHERE n <> '')""")
def version_sort(spark, d):
    p = t(spark, d, "pages").select("page_id", F.length("url").alias("a"), F.regexp_extract("url", "/([0-9]+)", 1).alias("b")).where("b <> ''")
    v = p.select("page_id", F.concat_ws(".", "a", "b").alias("version"))
    return windows.numbered(v, [windows.version_key(F.col("version")), F.col("page_id")], "place")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS heading FROM conversations""")
def carried_heading(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("heading"))
    return windows.carry_down(c, "heading", ["conv_id"], ["turn"])


# -- joins ----------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def resume_anti_join(spark, d):
    done = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.not_done(t(spark, d, "orders"), done, ["o_orderkey"]).select("o_orderkey")


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IS DISTINCT FROM 'BUILDING'
  AND (c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'))""")
def semi_join_checked(spark, d):
    o = t(spark, d, "orders")
    keys = o.where("o_orderpriority = '1-URGENT' OR o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    c = t(spark, d, "customer").where(~F.col("c_mktsegment").eqNullSafe("BUILDING"))
    return c.join(keys, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("""SELECT o_orderkey, parts FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def denormalise_orders(spark, d):
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber")
    return joins.with_list(t(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", F.col("l_partkey"), F.struct("l_linenumber", "l_partkey"), "parts")


@query("""SELECT a.doc_id, a.source, b.doc_id AS en_doc_id, b.doc_id IS NULL AS en_missing
  FROM documents a LEFT JOIN (SELECT source, min(doc_id) AS doc_id FROM documents WHERE lang = 'en' GROUP BY source) b USING (source) WHERE a.lang <> 'en'""")
def self_join_locale_twin(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source", "lang")
    en = docs.where("lang = 'en'").groupBy("source").agg(F.min("doc_id").alias("doc_id"))
    return joins.twins(docs.where("lang <> 'en'").drop("lang"), en, ["source"], "en_").select("doc_id", "source", "en_doc_id", "en_missing")


MONTHS = [f"{y}-{m:02d}-01" for y in range(1990, 2006) for m in (1, 4, 7, 10)]


@query(f"""SELECT o_orderkey, min(b) FILTER (b >= k) AS successor, max(b) FILTER (b <= k) AS predecessor
  FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS k FROM orders), (SELECT unnest({MONTHS}) AS b) GROUP BY o_orderkey""")
def asof_boundaries(spark, d):
    k = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t(spark, d, "orders").select("o_orderkey", joins.in_list(k, MONTHS, True).alias("successor"), joins.in_list(k, MONTHS, False).alias("predecessor"))


@query("""SELECT p.event_id, max_by(v.event_id, (v.ts, v.event_id)) AS view_id FROM events p LEFT JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts
  WHERE p.event_type = 'purchase' GROUP BY p.event_id""")
def nearest_event_before(spark, d):
    e = t(spark, d, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("v"))
    return joins.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, by=["user_id"], at="ts", value="v", out="view_id").select("event_id", "view_id")


@query("""SELECT p.event_id, min_by(v.event_id, (v.ts, -v.event_id)) AS view_id FROM events p LEFT JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view' AND v.ts >= p.ts
  WHERE p.event_type = 'purchase' GROUP BY p.event_id""")
def nearest_event_after(spark, d):
    e = t(spark, d, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("v"))
    return joins.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, by=["user_id"], at="ts", value="v", out="view_id", forward=True).select("event_id", "view_id")


LAYOUTS = [("1990-01-01", "first"), ("1995-06-01", "second"), ("1998-01-01", "third"), ("2001-03-01", "fourth")]


@query("""SELECT CASE WHEN k >= '2001-03-01' THEN 'fourth' WHEN k >= '1998-01-01' THEN 'third' WHEN k >= '1995-06-01' THEN 'second' ELSE 'first' END AS layout, count(*) AS n
  FROM (SELECT strftime(l_shipdate, '%Y-%m-%d') AS k FROM lineitem) GROUP BY 1""")
def range_layout(spark, d):
    k = joins.in_list(F.date_format("l_shipdate", "yyyy-MM-dd"), [b for b, _ in LAYOUTS], False)
    names = F.create_map(*(F.lit(x) for kv in LAYOUTS for x in kv))
    return t(spark, d, "lineitem").select(F.element_at(names, k).alias("layout")).groupBy("layout").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH old AS (SELECT o_orderkey, o_totalprice AS price FROM orders WHERE o_orderstatus <> 'P'),
  run AS (SELECT o_orderkey, o_totalprice + 1 AS price FROM orders WHERE o_orderpriority = '1-URGENT'), failed AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH')
  SELECT o_orderkey, coalesce(run.price, old.price) AS price FROM old FULL JOIN run USING (o_orderkey)
  WHERE run.price IS NOT NULL OR o_orderkey NOT IN (SELECT o_orderkey FROM failed)""")
def manifest_upsert(spark, d):
    o = t(spark, d, "orders")
    old = o.where("o_orderstatus <> 'P'").select("o_orderkey", F.col("o_totalprice").alias("price"))
    run = o.where("o_orderpriority = '1-URGENT'").select("o_orderkey", (F.col("o_totalprice") + 1).alias("price"))
    return joins.upsert(old, run, "o_orderkey", failed=o.where("o_orderpriority = '2-HIGH'").select("o_orderkey"), recheck=True)


@query("""SELECT p_partkey, count(l_orderkey) AS lines,
  count(*) FILTER (l_orderkey IS NOT NULL AND NOT (
    abs(u - p) < 1e-9 OR (abs(round(u * 100) / 100 - p) < 1e-9 AND abs(u - p) <= 0.02 * abs(p))
    OR abs(u * 100 - p) < 1e-9 OR (abs(round(u * 10000) / 100 - p) < 1e-9 AND abs(u * 100 - p) <= 0.02 * abs(p))
    OR abs(u * 0.01 - p) < 1e-9 OR (abs(round(u * 0.01 * 100) / 100 - p) < 1e-9 AND abs(u * 0.01 - p) <= 0.02 * abs(p)))) AS unmatched
  FROM (SELECT p_partkey, p_retailprice AS p, l_orderkey, l_extendedprice / l_quantity AS u FROM part LEFT JOIN lineitem ON l_partkey = p_partkey) GROUP BY p_partkey""")
def theta_number_match(spark, d):
    j = t(spark, d, "part").join(t(spark, d, "lineitem"), F.col("p_partkey") == F.col("l_partkey"), "left")
    hit = numeric.number_matches(F.col("p_retailprice"), F.lit(2), F.col("l_extendedprice") / F.col("l_quantity"))
    return j.groupBy("p_partkey").agg(F.count("l_orderkey").alias("lines"), F.count_if(F.col("l_orderkey").isNotNull() & ~hit).alias("unmatched"))


@query("SELECT s_suppkey, c_custkey FROM supplier, customer WHERE abs(s_acctbal - c_acctbal) <= 0.5")
def tolerance_join(spark, d):
    return joins.within(t(spark, d, "supplier"), t(spark, d, "customer"), "s_acctbal", "c_acctbal", 0.5).select("s_suppkey", "c_custkey")


@query("""SELECT p_partkey, (i - 1)::INT AS start_word, w[i] AS name FROM (SELECT p_partkey, string_split(lower(p_name), ' ') AS w FROM part), unnest(range(1, len(w) + 1)) AS u(i)
  WHERE w[i] IN (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) FROM part)""")
def dictionary_match(spark, d):
    p = t(spark, d, "part")
    names = p.select(F.explode(F.split(F.lower("p_name"), " ")).alias("name"))
    return joins.find_names(p, "p_partkey", "p_name", names, 1)


@query("""WITH k AS (SELECT md5(text) AS key, doc_id, lang, source FROM documents WHERE text IS NOT NULL)
  SELECT key, CASE WHEN count(DISTINCT doc_id) FILTER (lang = 'en') = 1 THEN min(doc_id) FILTER (lang = 'en')
    WHEN count(DISTINCT doc_id) FILTER (source = 'src1') = 1 THEN min(doc_id) FILTER (source = 'src1') END AS owner FROM k GROUP BY key HAVING count(DISTINCT doc_id) >= 2""")
def duplicate_owner(spark, d):
    k = t(spark, d, "documents").where("text IS NOT NULL").select(F.md5("text").alias("key"), "doc_id", "lang", "source")
    return joins.owners(k, "key", "doc_id", F.col("lang") == "en", F.col("source") == "src1")


@query("""SELECT event_type, regexp_replace(props, '[0-9]+', '#', 'g') AS shape, count(*) AS n, count(DISTINCT props) AS fillings FROM events GROUP BY 1, 2""")
def structural_copy(spark, d):
    e = t(spark, d, "events").withColumn("shape", F.regexp_replace("props", "[0-9]+", "#"))
    return e.groupBy("event_type", "shape").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("props").alias("fillings"))


@query("""SELECT n_nationkey, r_name AS found FROM nation LEFT JOIN region ON r_regionkey = n_regionkey""")
def name_or_hash_lookup(spark, d):
    r = t(spark, d, "region")
    names = r.select(F.lower("r_name").alias("key"), "r_name").where("r_regionkey < 3").unionByName(r.where("r_regionkey >= 3").select(hashing.fnv1a(F.col("r_name")).alias("key"), "r_name"))
    n = t(spark, d, "nation").join(r.select("r_regionkey", F.col("r_name").alias("rn")), F.col("n_regionkey") == F.col("r_regionkey"))
    return joins.lookup(n.select("n_nationkey", "rn"), names, F.col("rn"), hashing.fnv1a(F.col("rn")), "r_name", "found").select("n_nationkey", "found")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS k FROM orders) WHERE k = 1""")
def prioritised_lookup(spark, d):
    prio = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    o = t(spark, d, "orders").select("o_custkey", prio.alias("prio"), "o_orderkey", "o_orderstatus")
    return joins.by_priority(o, ["o_custkey"], ["prio", "o_orderkey"]).drop("prio")


# -- aggregates -----------------------------------------------------------------------------------

_RUNS = "SELECT user_id, ts::DATE AS day, coalesce(bool_or(event_type = 'error'), false) AS caught FROM events GROUP BY 1, 2"


def _runs(spark, d):
    e = t(spark, d, "events").withColumn("day", F.to_date("ts"))
    return aggregates.any_match(e, ["user_id", "day"], F.col("event_type") == "error")


@query(f"SELECT user_id, strftime(day, '%Y-%m-%d') AS day, caught FROM ({_RUNS})")
def any_match(spark, d):
    return _runs(spark, d).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"SELECT user_id, sum(caught::INT)::BIGINT AS votes, count(*) AS runs, 2 * sum(caught::INT) > count(*) AS caught FROM ({_RUNS}) GROUP BY user_id")
def majority_vote(spark, d):
    return aggregates.majority(_runs(spark, d), ["user_id"], "caught")


@query("""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS "both", count(*) FILTER (quality = 1 AND toxic <> 1) AS only_a, count(*) FILTER (quality <> 1 AND toxic = 1) AS only_b,
  count(*) FILTER (quality <> 1 AND toxic <> 1) AS neither FROM labels)
  SELECT c.*, round(least(1.0, 2 * (SELECT sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) + (only_a + only_b) * ln(0.5))) FROM range(0, least(only_a, only_b) + 1) AS r(i))), 12) AS p FROM c""")
def paired_contingency(spark, d):
    a, b = F.col("quality") == 1, F.col("toxic") == 1
    return aggregates.contingency(t(spark, d, "labels"), a, b).withColumn("p", F.round("p", 12))


def _labelled(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang", "source")
    return t(spark, d, "labels").join(docs, "doc_id")


@query("""SELECT lang, source, count(*) FILTER (toxic = 1) AS k, count(*) AS n, round(count(*) FILTER (toxic = 1) / count(*), 6) AS share FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, source)""")
def recall_rollup(spark, d):
    return aggregates.recall(_labelled(spark, d), ["lang", "source"], F.col("toxic") == 1)


@query()
def clopper_pearson_by_group(spark, d):
    r = aggregates.recall(_labelled(spark, d), ["source"], F.col("toxic") == 1, interval=True)
    return r.select("source", "k", "n", F.round("ci.lo", 9).alias("lo"), F.round("ci.hi", 9).alias("hi"))


@query("""SELECT source, count(*) FILTER (v = 'real') AS real, count(*) FILTER (v = 'unsure') AS cant_tell, count(*) AS judged, round(count(*) FILTER (v = 'real') / count(*), 6) AS precision,
  round(count(*) FILTER (v = 'real') / nullif(count(*) - count(*) FILTER (v = 'unsure'), 0), 6) AS precision_sure, round(1000 * count(*) / max(records), 6) AS per_1000
  FROM (SELECT source, CASE WHEN toxic = 1 THEN 'real' WHEN quality = 0 THEN 'unsure' ELSE 'not' END AS v, (SELECT count(*) FROM documents) AS records FROM labels JOIN documents USING (doc_id)) GROUP BY source""")
def precision_per_1000(spark, d):
    v = F.when(F.col("toxic") == 1, "real").when(F.col("quality") == 0, "unsure").otherwise("not")
    rows = _labelled(spark, d).withColumn("v", v).withColumn("records", F.lit(t(spark, d, "documents").count()))
    return aggregates.precision(rows, ["source"], "v", F.col("records"), right="real", unsure="unsure")


@query("""SELECT l_linestatus, round(coalesce(sum(CASE WHEN c IS NOT NULL THEN ((p - k) * i + k * r + c * o) / 1e6 END), 0), 6) AS cost, count(*) FILTER (c IS NULL) AS missing, count(*) AS lines
  FROM (SELECT l_linestatus, l_returnflag, l_quantity AS p, round(l_quantity * l_discount, 2) AS k, CASE WHEN l_tax > 0 THEN l_quantity * 2 END AS c FROM lineitem)
  JOIN (VALUES ('A', 1.5, 0.2, 6.0), ('N', 0.5, 0.1, 2.0), ('R', 3.0, 0.3, 15.0)) AS v(l_returnflag, i, r, o) USING (l_returnflag) GROUP BY l_linestatus""")
def weighted_cost(spark, d):
    prices = spark.createDataFrame([("A", 1.5, 0.2, 6.0), ("N", 0.5, 0.1, 2.0), ("R", 3.0, 0.3, 15.0)], "l_returnflag string, input double, cache_read double, output double")
    li = t(spark, d, "lineitem").select("l_linestatus", "l_returnflag", F.col("l_quantity").alias("p"), F.round(F.col("l_quantity") * F.col("l_discount"), 2).alias("k"), F.when(F.col("l_tax") > 0, F.col("l_quantity") * 2).alias("c"))
    return aggregates.cost(li, F.broadcast(prices), ["l_linestatus"], "l_returnflag", prompt="p", cached="k", completion="c")


@query("""SELECT event_type, grouping(event_type)::INT AS is_total, count(*) AS n, count(*) FILTER (value > 10) AS large, count(*) FILTER (value IS NULL) AS empty, count(*) FILTER (user_id < 50) AS early,
  round(count(*) FILTER (value > 10) / count(*), 4) AS large_share, round(count(*) FILTER (value IS NULL) / count(*), 4) AS empty_share, round(count(*) FILTER (user_id < 50) / count(*), 4) AS early_share
  FROM events GROUP BY GROUPING SETS ((), (event_type))""")
def coverage_summary(spark, d):
    return aggregates.coverage(t(spark, d, "events"), "event_type", {"large": F.col("value") > 10, "empty": F.col("value").isNull(), "early": F.col("user_id") < 50})


@query("SELECT p_type, part, count(*) AS n FROM (SELECT p_type, unnest(string_split(p_name, ' ')) AS part FROM part) GROUP BY 1, 2")
def exploded_rule_counts(spark, d):
    return aggregates.exploded_counts(t(spark, d, "part"), F.split("p_name", " "), ["p_type"])


@query("""WITH k AS (SELECT DISTINCT l_orderkey AS x FROM lineitem), m AS (SELECT unnest(range(0, (SELECT max(x) FROM k))) AS x EXCEPT SELECT x FROM k),
  g AS (SELECT x, x - row_number() OVER (ORDER BY x) AS grp FROM m) SELECT min(x) AS "first", max(x) AS "last" FROM g GROUP BY grp""")
def coverage_gaps(spark, d):
    return aggregates.gaps(t(spark, d, "lineitem"), "l_orderkey")


@query("SELECT lang, count(n_chars) AS n, sum(n_chars)::BIGINT AS total, median(n_chars)::DOUBLE AS median, max(n_chars) AS most FROM documents GROUP BY lang")
def size_stats(spark, d):
    return aggregates.sizes(t(spark, d, "documents"), "n_chars", ["lang"])


@query("SELECT l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS orders, count(DISTINCT (l_partkey, l_suppkey)) AS pairs FROM lineitem GROUP BY l_returnflag")
def distinct_counts(spark, d):
    li = t(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey", "l_suppkey").alias("pairs"))


@query("""WITH v AS (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders), n AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS n FROM v GROUP BY 1),
  c AS (SELECT o_custkey, o_orderpriority, count(*) AS c FROM v GROUP BY 1, 2)
  SELECT n.o_custkey, coalesce(string_agg(o_orderpriority, ',' ORDER BY o_orderpriority) FILTER (c = n), '') AS common, count(*) FILTER (c = n) = 1 AS decided FROM n JOIN c USING (o_custkey) GROUP BY 1""")
def vote_intersection(spark, d):
    votes = t(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.collect_set("o_orderpriority").alias("allowed"))
    return aggregates.intersection(votes, ["o_custkey"], "allowed").withColumn("common", F.array_join("common", ","))


@query("""WITH f AS (SELECT o_orderkey, 1 AS k, 'late' AS rule, 'o' || o_orderkey AS names, 'status ' || o_orderstatus AS detail FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT o_orderkey, 2, 'large', 't' || o_orderkey, 'over 400000' FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT o_orderkey, 3, 'urgent', 'u' || o_orderkey, 'urgent' FROM orders WHERE o_orderpriority = '1-URGENT')
  SELECT o_orderkey, string_agg(rule, '+' ORDER BY k) AS rule, min_by(names, k) AS names, string_agg(detail, '; ' ORDER BY k) AS detail FROM f GROUP BY o_orderkey""")
def flag_merge(spark, d):
    o = t(spark, d, "orders")

    def flag(cond, rule, letter, detail):
        return o.where(cond).select("o_orderkey", F.lit(0).alias("pos"), F.lit(rule).alias("rule"), F.concat(F.lit(letter), F.col("o_orderkey").cast("string")).alias("names"), detail.alias("detail"))

    flags = setops.union_all(flag("o_orderstatus = 'P'", "late", "o", F.concat(F.lit("status "), F.col("o_orderstatus"))), flag("o_totalprice > 400000", "large", "t", F.lit("over 400000")), flag("o_orderpriority = '1-URGENT'", "urgent", "u", F.lit("urgent")))
    return aggregates.merged_flags(flags, ["o_orderkey"], ["late", "large", "urgent"])


# -- sets -----------------------------------------------------------------------------------------


@query("""SELECT count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b, count(*) FILTER (a AND b) AS "both" FROM (SELECT doc_id, bool_or(s = 1) AS a, bool_or(s = 2) AS b FROM
  (SELECT doc_id, 1 AS s FROM documents UNION ALL SELECT doc_id, 2 FROM labels) GROUP BY doc_id)""")
def setdiff_keys(spark, d):
    return setops.key_counts(t(spark, d, "documents"), t(spark, d, "labels"), ["doc_id"])


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def missing_keys(spark, d):
    return setops.missing(t(spark, d, "documents"), t(spark, d, "labels"), ["doc_id"])


@query("""SELECT l_partkey, l_suppkey, 'removed' AS change FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')
  UNION ALL SELECT l_partkey, l_suppkey, 'added' FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A')""")
def changed_paths(spark, d):
    li = t(spark, d, "lineitem")
    return setops.changed_paths(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"])


# -- text, hashing and numbers --------------------------------------------------------------------


@query("""SELECT page_id, length(s) AS n, md5(s) AS sum FROM (SELECT page_id, regexp_replace(regexp_replace(html, '(?i)</?(?:br|li|ul|ol|p|hr|rules)\\b[^<>]*>', ' ', 'g'), '<[^<>]*>', '', 'g') AS s FROM pages)""")
def strip_markup(spark, d):
    p = t(spark, d, "pages").select("page_id", text.strip_tags(F.col("html")).alias("s"))
    return p.select("page_id", F.length("s").cast("long").alias("n"), F.md5("s").alias("sum"))


@query("""SELECT n_nationkey, n_name AS owner, 'Value' AS name, n_regionkey AS "precision", 100.0::DOUBLE AS factor FROM nation""")
def token_grammar(spark, d):
    tok = F.concat(F.lit("spell."), "n_name", F.lit(":Value."), F.col("n_regionkey").cast("string"), F.lit("*100"))
    return t(spark, d, "nation").select("n_nationkey", text.parse_token(tok).alias("x")).select("n_nationkey", "x.*")


@query("""SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS base, true AS had FROM part""")
def affix_strip(spark, d):
    name = F.concat(F.lit("TooltipTT_"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_Display"))
    return t(spark, d, "part").select("p_partkey", text.base_name(name).alias("x")).select("p_partkey", "x.*")


@query("""SELECT c_custkey, array_to_string(list_transform(regexp_extract_all(c_name, '[A-Z]?[a-z]+|[0-9]+'), lambda x: lower(x)), ' ') AS words FROM customer""")
def camel_words(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.array_join(text.camel_words(F.col("c_name")), " ").alias("words"))


_F = text.LINE_FEATURES
_HAS = ", ".join(f"regexp_matches(text, '{p}') AS {k}_" for k, p in _F.items())


@query(f"""SELECT conv_id, turn, CASE WHEN translation_ THEN 'translation' WHEN wording_ AND strong THEN 'wording' WHEN number_ THEN 'typed_number' WHEN wording_ THEN 'wording' ELSE 'other' END AS kind,
  CASE WHEN fix_ THEN 'high' ELSE 'low' END AS confidence
  FROM (SELECT conv_id, turn, length(text) AS n, regexp_matches(text, '(?i)\\b(?:typos?|spelling|grammar)\\b') AS strong, {_HAS} FROM (SELECT conv_id, turn, 'Fixed tooltip: ' || text AS text FROM conversations)) WHERE n >= 12 AND text_""")
def line_classifier(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", text.classify_line(F.concat(F.lit("Fixed tooltip: "), F.col("text"))).alias("x"))
    return c.where("x IS NOT NULL").select("conv_id", "turn", "x.kind", "x.confidence")


@query()
def typed_numbers(spark, d):
    return t(spark, d, "documents").select("doc_id", F.posexplode(text.typed_numbers(F.col("text"))).alias("pos", "n")).select("doc_id", "pos", "n.*")


@query()
def quoted_words(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", text.reduce_names(F.col("text")).alias("names"))


@query()
def sentence_quote(spark, d):
    return t(spark, d, "documents").select("doc_id", text.quote_for(F.col("text"), ["the", "de", "und"]).alias("quote"))


@query("""SELECT n_nationkey, sha256('["' || n_name || '","' || n_regionkey || '"]') AS key FROM nation""")
def sha256_key(spark, d):
    return t(spark, d, "nation").select("n_nationkey", hashing.sha_key(F.col("n_name"), F.col("n_regionkey")).alias("key"))


@query("""SELECT n_nationkey, printf('{%08x}', list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(n_name) + 1), lambda i: ascii(lower(n_name)[i])::BIGINT)), lambda h, b: xor(h, b) * 16777619 % 4294967296)) AS hash FROM nation""")
def fnv1a_names(spark, d):
    return t(spark, d, "nation").select("n_nationkey", hashing.fnv1a(F.col("n_name")).alias("hash"))


@query()
def xxh64_names(spark, d):
    return t(spark, d, "nation").select("n_nationkey", hashing.xxh64("n_name").alias("hash"))


@query("""WITH b AS (SELECT p_brand, list_sort(list(DISTINCT p_size)) AS v FROM part GROUP BY p_brand)
  SELECT p_brand, (SELECT max(g) FROM (VALUES (5.0), (1.0), (0.5), (0.1), (0.05), (0.01)) AS s(g) WHERE len(list_filter(v, lambda x: abs(x / g - round(x / g)) >= 1e-6)) = 0)::DOUBLE AS grid,
  CASE WHEN len(list_filter(v, lambda x: x * 3 <> round(x * 3))) = 0 THEN list_sum(list_transform(v, lambda x: x * 3))::DOUBLE END AS tripled, CASE WHEN len(list_filter(v, lambda x: x // 2 * 2 <> x)) = 0 THEN list_sum(v) / 2 END AS halved FROM b""")
def exact_scaling(spark, d):
    b = t(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set(F.col("p_size").cast("double"))).alias("v"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    return b.select("p_brand", numeric.grid_step(F.col("v")).alias("grid"), total(numeric.scaled(F.col("v"), F.lit(3.0))).alias("tripled"), total(numeric.scaled(F.col("v"), F.lit(0.5))).alias("halved"))


@query("""SELECT n_nationkey, lv::INT AS level, round(n_nationkey * (1 - (lv - 1) / 17) + (n_nationkey + 10) * ((lv - 1) / 17), 6) AS even,
  round(n_nationkey * (1 - (lv - 1) * (0.7025 + 0.0175 * (lv - 1)) / 17) + (n_nationkey + 10) * ((lv - 1) * (0.7025 + 0.0175 * (lv - 1)) / 17), 6) AS grown FROM (SELECT n_nationkey::DOUBLE AS n, n_nationkey, unnest(range(1, 19)) AS lv FROM nation)""")
def level_interpolation(spark, d):
    n = F.col("n_nationkey").cast("double")
    levels = F.arrays_zip(numeric.interpolated(n, n + 10, F.lit(False)).alias("e"), numeric.interpolated(n, n + 10, F.lit(True)).alias("g"))
    x = t(spark, d, "nation").select("n_nationkey", F.posexplode(levels).alias("i", "x"))
    return x.select("n_nationkey", (F.col("i") + 1).alias("level"), F.round(F.col("x").getField("e"), 6).alias("even"), F.round(F.col("x").getField("g"), 6).alias("grown"))


@query("""SELECT n_nationkey, lv::INT AS level, (10 + least(lv - 1, 4) * n_regionkey + CASE WHEN lv >= 6 THEN 5 + (lv - 5) * 2 ELSE 0 END)::DOUBLE AS value FROM (SELECT n_nationkey, n_regionkey, unnest(range(1, 19)) AS lv FROM nation)""")
def breakpoints(spark, d):
    points = F.array(F.struct(F.lit(6).alias("level"), F.lit(5.0).alias("bonus"), F.lit(2.0).alias("per_level")))
    x = t(spark, d, "nation").select("n_nationkey", F.posexplode(numeric.stepped(F.lit(10.0), F.col("n_regionkey"), points)).alias("i", "value"))
    return x.select("n_nationkey", (F.col("i") + 1).alias("level"), "value")


# -- sampling and graphs --------------------------------------------------------------------------


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7:audit:' || doc_id), doc_id) AS k FROM documents) WHERE k <= 5""")
def hash_sample_topn(spark, d):
    return sampling.sample(t(spark, d, "documents").select("doc_id", "source"), 5, 7, "audit", ["doc_id"], ["source"])


@query("""SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('7:quota:' || doc_id), doc_id) AS k, dense_rank() OVER (ORDER BY lang) AS i FROM documents)
  WHERE k <= 50 // 4 + CASE WHEN i <= 50 % 4 THEN 1 ELSE 0 END""")
def stratified_quota(spark, d):
    langs = spark.createDataFrame([("de",), ("en",), ("es",), ("fr",)], "lang string")
    own = langs.select("lang", F.get(numeric.shares(F.lit(50), F.lit(4)), F.array_position(F.array(*map(F.lit, ["de", "en", "es", "fr"])), F.col("lang")).cast("int") - 1).alias("n"))
    docs = sampling.sample(t(spark, d, "documents").select("doc_id", "lang"), 13, 7, "quota", ["doc_id"], ["lang"])
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("lang").orderBy(sampling.draw_key(7, "quota", F.col("doc_id")), "doc_id"))
    return docs.withColumn("k", k).join(F.broadcast(own), "lang").where("k <= n").select("lang", "doc_id")


@query("""WITH s AS (SELECT doc_id, quality, toxic, row_number() OVER (ORDER BY md5('7:spot:' || doc_id), doc_id) AS k FROM labels) SELECT count(*) AS checked, round(avg(CASE WHEN quality + toxic = 1 THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM s WHERE k <= 40""")
def spot_check(spark, d):
    s = sampling.sample(t(spark, d, "labels"), 40, 7, "spot", ["doc_id"])
    return s.agg(F.count(F.lit(1)).alias("checked"), F.round(F.avg(F.when(F.col("quality") + F.col("toxic") == 1, 1.0).otherwise(0.0)), 6).alias("agreement"))


@query("""SELECT doc_id AS node, min(doc_id) OVER (PARTITION BY md5(text)) AS component FROM documents WHERE text IS NOT NULL AND md5(text) IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1)""")
def connected_components(spark, d):
    from pyspark.sql import Window

    docs = t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5("text").alias("k"))
    pairs = docs.withColumn("next", F.lead("doc_id").over(Window.partitionBy("k").orderBy("doc_id"))).where("next IS NOT NULL")
    return graph.connected_components(pairs, "doc_id", "next")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT a.conv_id || ':' || a.turn AS s, b.conv_id || ':' || b.turn AS t FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
  r AS (SELECT s AS source, t AS target, 1 AS steps FROM e UNION SELECT source, t, steps + 1 FROM r JOIN e ON s = target) SELECT source, target, min(steps)::INT AS steps FROM r GROUP BY 1, 2""")
def transitive_readers(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn").distinct()
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("after"))
    e = c.join(nxt, ["conv_id", "turn"]).select(F.concat_ws(":", "conv_id", "turn").alias("a"), F.concat_ws(":", "conv_id", "after").alias("b"))
    return graph.reachable(e, "a", "b")
