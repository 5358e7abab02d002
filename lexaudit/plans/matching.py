"""Queries that match documents, formulas, names and lines with each other, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.operators import aggregates, dictionary, graph, joins, paths
from lexaudit.sources import pages

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


# -- key paths --------------------------------------------------------------------------------------

#: What is put in place of what in the properties of every third click, to be found again as changes.
PUT = (('"device"', '"gear"'), ('"k"', '"key"'), ('"qty"', '"count"'), ('"ver": "3', '"ver": "9'))


def _put(text: str, sql: bool) -> str:
    for old, new in PUT:
        text = f"replace({text}, '{old}', '{new}')"
    return text


_STEP = "CASE WHEN json_type(n.v) = 'ARRAY' THEN '[' || e.key || ']' ELSE '/' || replace(replace(replace(e.key, '~', '~0'), '/', '~1'), '[', '~2') END"


@query(f"""WITH RECURSIVE d AS (SELECT DISTINCT click_id, props FROM clicks WHERE json_valid(props)),
ds AS (SELECT click_id, 'a' AS side, props::JSON AS v FROM d UNION ALL
       SELECT click_id, 'b', (CASE WHEN click_id % 3 = 0 THEN {_put("props", True)} ELSE props END)::JSON FROM d),
n(click_id, side, path, v) AS (SELECT click_id, side, '', v FROM ds UNION ALL
       SELECT n.click_id, n.side, n.path || {_STEP}, e.value FROM n, json_each(n.v) e WHERE json_type(n.v) IN ('ARRAY', 'OBJECT')),
x AS (SELECT click_id, side, path, v::VARCHAR AS v, json_type(v) NOT IN ('ARRAY', 'OBJECT') OR v::VARCHAR IN ('[]', '{{}}') AS leaf FROM n WHERE path <> ''),
j AS (SELECT coalesce(a.click_id, b.click_id) AS click_id, coalesce(a.path, b.path) AS path, a.v AS va, b.v AS vb, a.leaf AS la, b.leaf AS lb
      FROM (SELECT * FROM x WHERE side = 'a') a FULL JOIN (SELECT * FROM x WHERE side = 'b') b ON a.click_id = b.click_id AND a.path = b.path),
ga AS (SELECT click_id, va AS v, min(path) AS path FROM j WHERE vb IS NULL GROUP BY ALL HAVING count(*) = 1),
gb AS (SELECT click_id, vb AS v, min(path) AS path FROM j WHERE va IS NULL GROUP BY ALL HAVING count(*) = 1),
p AS (SELECT ga.click_id, ga.path, gb.path AS other FROM ga JOIN gb USING (click_id, v)),
under AS (SELECT DISTINCT q.click_id, q.path FROM p q JOIN p t ON t.click_id = q.click_id AND (starts_with(q.path, t.path || '/') OR starts_with(q.path, t.path || '[')) AND (starts_with(q.other, t.other || '/') OR starts_with(q.other, t.other || '['))),
out AS (SELECT click_id, 'changed' AS change, path, NULL AS other FROM j WHERE va <> vb AND (la OR lb)
  UNION ALL SELECT click_id, 'renamed', path, other FROM p ANTI JOIN under USING (click_id, path)
  UNION ALL SELECT click_id, 'removed', path, NULL FROM j WHERE vb IS NULL AND la AND NOT EXISTS (SELECT 1 FROM p WHERE p.click_id = j.click_id AND (p.path = j.path OR starts_with(j.path, p.path || '/') OR starts_with(j.path, p.path || '[')))
  UNION ALL SELECT click_id, 'added', path, NULL FROM j WHERE va IS NULL AND lb AND NOT EXISTS (SELECT 1 FROM p WHERE p.click_id = j.click_id AND (p.other = j.path OR starts_with(j.path, p.other || '/') OR starts_with(j.path, p.other || '['))))
SELECT * FROM out""")
def renamed_paths(spark, d):
    """The properties of clicks before and after some keys and values were replaced: what was renamed, removed, added and changed."""
    docs = t(spark, d, "clicks").select("click_id", "props").where("click_id IS NOT NULL").distinct()
    after = F.when(F.col("click_id") % 3 == 0, F.expr(_put("props", False))).otherwise(F.col("props"))
    return paths.differences(docs, docs.withColumn("props", after), ["click_id"], "props")


# -- lists with one element left out ----------------------------------------------------------------


@query("""WITH l AS (SELECT o_custkey, o_orderkey, list(l_returnflag || l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS modes FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
  c AS (SELECT o_custkey, modes, count(*) AS n FROM l GROUP BY ALL),
  w AS (SELECT DISTINCT o_custkey, modes, n, list_concat(modes[1:i - 1], modes[i + 1:]) AS rest FROM (SELECT *, unnest(range(1, len(modes) + 1)) AS i FROM c))
  SELECT a.o_custkey, array_to_string(a.modes, ',') AS short, array_to_string(b.modes, ',') AS "full", a.n AS n_short, b.n AS n_full FROM c a JOIN w b ON a.o_custkey = b.o_custkey AND a.modes = b.rest""")
def one_line_left_out(spark, d):
    """Orders of a customer as lists of line states: lists that are another one with a line left out, and how many orders have each."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    lists = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.concat(x["l_returnflag"], x["l_linestatus"])).alias("modes")).join(o, "o_orderkey")
    classes = lists.groupBy("o_custkey", "modes").agg(F.count(F.lit(1)).alias("n"))
    pairs = joins.one_left_out(classes.withColumnRenamed("n", "n_short"), classes.select("o_custkey", F.col("modes").alias("all"), F.col("n").alias("n_full")), ["o_custkey"], "modes", "all")
    return pairs.select("o_custkey", F.array_join("modes", ",").alias("short"), F.array_join("all", ",").alias("full"), "n_short", "n_full")


# -- names in texts ---------------------------------------------------------------------------------

_WORDS = "list_filter(string_split_regex(replace(lower(coalesce(text, '')), 'ς', 'σ'), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


@query(f"""WITH RECURSIVE b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
n AS (SELECT DISTINCT array_to_string(w[1:least(len(w), item_id % 8 + 1)], ' ') AS name, least(len(w), item_id % 8 + 1) AS k FROM b WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, i, k, array_to_string(w[i + 1:i + k], ' ') AS name FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d), range(1, 9) g(k) WHERE i + k <= len(w)),
h AS (SELECT doc_id, i AS a, i + max(k) AS z, arg_max(name, k) AS name FROM s JOIN n USING (name, k) GROUP BY doc_id, i),
nx AS (SELECT h.*, x.a AS next FROM h ASOF LEFT JOIN h x ON x.doc_id = h.doc_id AND h.z <= x.a),
walk AS (SELECT nx.* FROM nx JOIN (SELECT doc_id, min(a) AS a FROM h GROUP BY doc_id) USING (doc_id, a) UNION ALL SELECT nx.* FROM walk JOIN nx ON nx.doc_id = walk.doc_id AND nx.a = walk.next)
SELECT doc_id, a::INT AS start_word, name FROM walk""")
def passages_named(spark, d):
    """Where the first one to eight words of benchmark passages stand in documents, the leftmost and longest of overlapping ones."""
    w = dictionary.words(F.col("text"))
    names = t(spark, d, "benchmark").select(F.array_join(F.slice(w, F.lit(1), (F.col("item_id") % 8 + 1).cast("int")), " ").alias("name")).where("name <> ''")
    return joins.find_names(t(spark, d, "documents"), "doc_id", "text", names, 8)


# -- sizes ------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, round(sum(l_extendedprice), 2) AS total, median(l_extendedprice)::DOUBLE AS median, max(l_extendedprice) AS most FROM lineitem GROUP BY ALL""")
def line_sizes(spark, d):
    """Count, sum, exact median and largest price of lines by flag and status."""
    s = aggregates.sizes(t(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"])
    return s.withColumn("total", F.round("total", 2))


# -- groups of entries ------------------------------------------------------------------------------


@query(f"""WITH e AS (SELECT o_orderkey AS k, o_orderkey // 10 AS q, o_orderkey % 10 AS c FROM orders), seed AS (SELECT q FROM e WHERE c = 1),
pre AS (SELECT e.k, arg_max(seed.q, i) AS q FROM e, range(1, 20) g(i), seed WHERE c IN (2, 7) AND i <= length(e.q::VARCHAR) AND seed.q::VARCHAR = left(e.q::VARCHAR, i) GROUP BY e.k),
own AS (SELECT k, 'G' || (q % 400) AS "group", 'AbilityObject' AS source, 'AbilityObject' AS joined_by FROM e WHERE c = 0
  UNION ALL SELECT k, 'script name Hero' || q, 'slot spell', 'slot spell' FROM e WHERE c = 1
  UNION ALL SELECT k, 'script name Hero' || q, 'slot spell', 'script-name prefix' FROM pre
  UNION ALL SELECT k, 'script name Hero' || q, 'slot spell', 'AbilityObject in next' FROM e JOIN seed USING (q) WHERE c = 3 AND k % 20 = 3),
far AS (SELECT e.k, 'script name Hero' || pre.q AS "group" FROM e JOIN pre ON pre.k = e.k - 2 WHERE c = 4),
two AS (SELECT e.k, min('script name Hero' || pre.q) AS "group" FROM e JOIN pre ON pre.k IN (e.k - 4, e.k + 6) WHERE c = 6 GROUP BY e.k HAVING count(DISTINCT pre.q) = 1),
every AS (SELECT * FROM own UNION ALL SELECT k, "group", 'slot spell', '{graph.LINKED}' FROM (SELECT * FROM far UNION ALL SELECT e.k, far."group" FROM e JOIN far ON far.k = e.k - 1 WHERE c = 5 UNION ALL SELECT * FROM two))
SELECT 'orders' AS folder, 'p' || k AS path, "group", source, joined_by FROM every WHERE "group" IN (SELECT "group" FROM every GROUP BY "group" HAVING count(*) > 1)""")
def grouped_entries(spark, d):
    """All orders as entries of one folder, ten kinds in turn: grouped by object, seed, longest beginning, a later file and links."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.floor(F.col("o_orderkey") / 10).alias("q"), (F.col("o_orderkey") % 10).cast("int").alias("c"))
    k, q, c = F.col("k"), F.col("q"), F.col("c")
    text = lambda *x: F.concat(*(y.cast("string") if isinstance(y, Column) else F.lit(y) for y in x))
    names = [text("Obj", k), text("Hero", q), text("hero", q, "Blast"), text("Other", k), text("Lone", k), text("Far", k), text("Both", k), text("HERO", q, "BasicAttack"), text("odyssey_Hero", q), text("Single", k)]
    path = lambda key: text("p", key)
    spells = o.select(F.lit("orders").alias("folder"), path(k).alias("path"), F.element_at(F.array(*names), c + 1).alias("name"), F.when(c == 0, text("G", q % 400)).alias("object_group"), c.isin(1, 8).alias("is_slot"))
    later = o.where((c == 3) & (k % 20 == 3)).select(F.lit("orders").alias("folder"), text("OTHER", k).alias("name"), text("HERO", q).alias("root"), F.lit("next").alias("where"))
    steps = [F.array()] * 4 + [F.array(F.lit(-2)), F.array(F.lit(-1)), F.array(F.lit(-4), F.lit(6)), F.array(), F.array(F.lit(-6)), F.array(F.lit(-9))]
    one = o.select(path(k).alias("a"), F.explode(F.element_at(F.array(*(s.cast("array<int>") for s in steps)), c + 1)).alias("to"), "k").select("a", path(k + F.col("to")).alias("b"))
    one = one.join(o.select(path(k).alias("b")).hint("merge"), "b", "left_semi").select(F.lit("orders").alias("folder"), "a", "b")
    edges = one.unionByName(one.select("folder", F.col("b").alias("a"), F.col("a").alias("b")))
    return graph.assign_groups(spells, edges, later)


# -- lines of pages ---------------------------------------------------------------------------------

#: What turns the given pages into ones with headings of every level and quotes around their menus.
_HEADED = (("<h1", "<h2"), ("</h1>", "</h2>"), ("<nav>", "<h3>Menu &amp; more</h3><blockquote>Go:<nav>"), ("</nav>", "</nav>there</blockquote>"), ("<footer", "<h4>End</h4><footer"))


def _headed() -> str:
    text = "html"
    for old, new in _HEADED:
        text = f"replace({text}, '{old}', '{new}')"
    return f"CASE WHEN page_id % 3 = 0 THEN html ELSE {text} END"


def lines_sql(html: str) -> str:
    """The lines of pages whose html is a piece of SQL, by windows over the pieces of each page."""
    return f"""WITH l AS (SELECT page_id, regexp_extract_all({html}, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|</?[a-zA-Z][^>]*>|<![^>]*>|[^<]+') AS w FROM pages),
t AS (SELECT page_id, i AS ix, w[i] AS piece, lower(regexp_extract(w[i], '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, w[i][1:2] = '</' AS ends FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM l)),
p AS (SELECT page_id, ix, CASE WHEN tag IN ('', 'br') THEN 'text' WHEN ends THEN 'end' ELSE 'start' END AS kind, CASE WHEN tag = 'br' THEN '' ELSE tag END AS tag,
    CASE WHEN tag = 'br' THEN ' ' ELSE replace(replace(replace(replace(piece, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') END AS piece
  FROM t WHERE piece[1:2] <> '<!' AND tag IN ('', 'br', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'p', 'li', 'td', 'ul', 'ol', 'table', 'blockquote')),
f AS (SELECT *, kind = 'start' AND tag[1:1] = 'h' OR kind = 'end' AND tag IN ('ul', 'ol', 'table', 'blockquote') AS above, sum(CASE WHEN tag <> 'blockquote' THEN 0 WHEN kind = 'start' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY ix) AS depth FROM p),
g AS (SELECT *, CASE WHEN tag = 'p' THEN min(ix) FILTER (above OR tag IN ('p', 'li', 'td')) OVER up WHEN tag = 'li' THEN min(ix) FILTER (above OR tag = 'li') OVER up
    WHEN tag = 'td' THEN min(ix) FILTER (above OR tag = 'td') OVER up WHEN tag[1:1] = 'h' THEN min(ix) FILTER (tag[1:1] = 'h') OVER up END AS "close" FROM f
  WINDOW up AS (PARTITION BY page_id ORDER BY ix ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
o AS (SELECT page_id, ix, tag, depth, coalesce("close", 1000000000) AS "close", CASE WHEN tag = 'blockquote' THEN depth END AS level FROM g WHERE kind = 'start' AND tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'p', 'li', 'td', 'blockquote')),
own AS (SELECT x.page_id, x.ix, any_value(x.piece) AS piece, arg_max(o.ix, o.ix) AS owner, arg_max(o.tag, o.ix) AS tag, arg_max(o.depth, o.ix) AS depth
  FROM g x JOIN o ON o.page_id = x.page_id AND o.ix < x.ix AND o."close" > x.ix WHERE x.kind = 'text'
    AND (o.level IS NULL OR o.level <= x.depth AND o.ix = (SELECT max(b.ix) FROM o b WHERE b.page_id = x.page_id AND b.ix < x.ix AND b.level = o.level)) GROUP BY x.page_id, x.ix),
s AS (SELECT page_id, owner AS ix, tag, depth > 0 AS quote, trim(regexp_replace(string_agg(piece, '' ORDER BY ix), '\\s+', ' ', 'g')) AS text FROM own GROUP BY ALL),
h AS (SELECT *, max(CASE WHEN tag = 'h2' THEN ix END) OVER w AS a2, max(CASE WHEN tag = 'h3' THEN ix END) OVER w AS a3, max(CASE WHEN tag = 'h4' THEN ix END) OVER w AS a4 FROM s WINDOW w AS (PARTITION BY page_id ORDER BY ix))
SELECT h.page_id, (row_number() OVER (PARTITION BY h.page_id ORDER BY h.ix) - 1)::INT AS pos, coalesce(x2.text, '') AS section, CASE WHEN a3 > coalesce(a2, -1) THEN x3.text ELSE '' END AS subject,
  CASE WHEN a4 > greatest(coalesce(a2, -1), coalesce(a3, -1)) THEN x4.text ELSE '' END AS ability, h.text, h.tag, h.quote
FROM h LEFT JOIN s x2 ON x2.page_id = h.page_id AND x2.ix = a2 LEFT JOIN s x3 ON x3.page_id = h.page_id AND x3.ix = a3 LEFT JOIN s x4 ON x4.page_id = h.page_id AND x4.ix = a4
WHERE h.text <> '' AND h.tag[1:1] <> 'h'"""


@query(lines_sql(_headed()))
def headed_lines(spark, d):
    """Lines of pages that were given headings and quotes, with the headings above them."""
    return pages.page_lines(t(spark, d, "pages").withColumn("html", F.expr(_headed())))


SQL["html_lines_with_context"] = lines_sql("html")  # the query is among those of scoring
