"""Queries of the consistency checks and of scoring: documents are made of the rows of part, and SQL says what
each check must find in them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.functions import hashing
from lexaudit.operators import assemble, checks, evaluate
from lexaudit.sources.shared import spread, written

S, K, T = "$s$", "$k$", "$t$"  # the size of a part as a number, a hundredth of it, and the size inside a string


def _doc(placeholders: dict, ability: tuple = (), text: str = "", typed: tuple = (), **own) -> dict:
    spell = {"spell": "NelaQ", "slot": "Q", "ranks": [1, 2]} | own
    return {"text": text, "placeholders": placeholders, "spell": spell, "ability": list(ability), "typed_numbers": list(typed)}


def _tip(value: str, parts: list) -> dict:
    return {"kind": "calculation", "value": value, "formula": {"tooltip_only": True, "parts": parts}}


def _ratio(stat: str, coef) -> dict:
    return {"stat": stat, "coef": coef}


_BASE = {"dv": "Base"}
_OTHER = {"spell": "NelaQ2", "slot": "other"}

#: One document of each kind; p_partkey modulo their number tells which one a row gets.
DOCS = [
    _doc({"TooltipDamage": _tip(T, [_BASE])}, calculations={"Damage": {"parts": [1], "value": "25"}}),
    _doc({"Total": _tip("40", [_ratio("AP", K)])}, coefficients={"mCoefficient": 0.25}),
    _doc({"TotalOne": _tip("40", [_BASE, _ratio("AP", K)])}, data_values={"Base": [1, 2]}, calculations={"Hit": {"parts": [_BASE, _ratio("AP", 0.25)], "value": "41"}}),
    _doc({"Hit": _tip("40", [_BASE])}, calculations={"HitAll": {"parts": [_BASE, _ratio("AP", 0.6)], "value": T}}),
    _doc({"Damage": {"kind": "calculation", "value": "25", "of": "NelaQ2", "formula": {"parts": [1]}}}, (_OTHER,), calculations={"damage": {"parts": [2], "value": T}}),
    _doc({"TooltipDamage": _tip("25", [_BASE, _ratio("AP", K)])}, coefficients={"mCoefficient": 0.3}, calculations={"Damage": {"parts": [3], "value": T}}),
    _doc({}, text=f"{T} damage dealt", typed=({"value": S, "text": T, "start": 0, "end": 2},), data_values={"A": [0.3, 7]}),
    _doc({"TooltipDamage": _tip("unresolved: x", [2])}, calculations={"Damage": {"parts": [1], "value": T}}),
    _doc({"SlowTT": {"kind": "data_value", "value": T}}, data_values={"SlowTT": [K, 0.3], "Slow": [0.25, 0.3]}),
    _doc({"Total": _tip("40", [{"dv": "TooltipBase"}])}, data_values={"TooltipBase": [S, 2], "Base": [25, 2]}),
    _doc({"Base": {"kind": "data_value", "value": "25", "of": "NelaQ2"}}, (_OTHER | {"data_values": {"Base": [25]}},), data_values={"Base": [S, S]}),
    _doc({"Total": _tip("40", [_ratio("AD", K)])}, calculations={"Other": {"parts": [_ratio("AD", 0.25)]}}),
]


def inputs(spark: SparkSession, d: str) -> DataFrame:
    """(id, input, planted_id): a document for each part, every fifth round of kinds in another language."""
    p = spark.read.parquet(f"{d}/part.parquet")
    one = F.element_at(F.array(*(F.lit(json.dumps(x)) for x in DOCS)), (F.col("p_partkey") % len(DOCS) + 1).cast("int"))
    for mark, put in ((json.dumps(S), F.col("p_size")), (json.dumps(K), F.col("p_size") / 100.0), (T, F.col("p_size"))):
        one = F.replace(one, F.lit(mark), put.cast("string"))
    lang = F.when(F.floor(F.col("p_partkey") / len(DOCS)) % 5 == 4, "de_de").otherwise(checks.ENGLISH)
    return p.select(F.concat_ws(":", F.lit("1.1"), lang, "p_partkey").alias("id"), one.alias("input"), F.col("p_partkey").cast("string").alias("planted_id"))


def check_flags(spark: SparkSession, d: str) -> DataFrame:
    """All flags of the made documents."""
    return checks.check_inputs(inputs(spark, d)).select("id", "names", "check", "rule", "detail", "placeholder", "value_name", "planted_id", "text_field", "locale")


_P = f"""p AS (SELECT p_partkey AS k, p_partkey % {len(DOCS)} AS c, (p_partkey // {len(DOCS)}) % 5 = 4 AS foreign_, p_size AS s, p_size / 100.0::DOUBLE AS r FROM part),
f AS (SELECT *, '1.1:en_us:' || k AS id,
    CASE WHEN c IN (0, 8, 9) AND s <> 25 THEN 'name' WHEN c IN (1, 11) AND s <> 25 THEN 'ratio' WHEN c = 2 AND s <> 25 OR c = 3 THEN 'copy' WHEN c IN (4, 10) AND s <> 25 THEN 'stale'
      WHEN c = 5 THEN nullif(concat_ws('+', CASE WHEN s <> 25 THEN 'name' END, CASE WHEN s <> 30 THEN 'ratio' END), '') WHEN c = 6 AND s NOT IN (7, 30) THEN 'typed_number' END AS rule,
    CASE c WHEN 0 THEN 'TooltipDamage' WHEN 1 THEN 'Total' WHEN 2 THEN 'TotalOne' WHEN 3 THEN 'Hit' WHEN 4 THEN 'Damage' WHEN 5 THEN 'TooltipDamage' WHEN 8 THEN 'SlowTT' WHEN 9 THEN 'Total' WHEN 10 THEN 'Base' WHEN 11 THEN 'Total' END AS name
  FROM p WHERE NOT foreign_)"""

CHECK_FLAGS = f"""WITH {_P}
SELECT id, CASE WHEN c = 6 THEN 'the typed number ' || s || ' in "' || s || ' damage dealt"' ELSE '@' || name || '@ shows ' || CASE WHEN c IN (0, 8) THEN s::VARCHAR WHEN c IN (4, 5, 10) THEN '25' ELSE '40' END END AS names,
  CASE WHEN c = 6 THEN 'typed_number' ELSE 'tooltip_calc' END AS "check", rule,
  CASE c WHEN 0 THEN 'TooltipDamage is ' || s || ' but the gameplay calculation Damage is 25'
    WHEN 1 THEN 'its AP ratio ' || r || ' is none of the spell''s coefficients (0.25)'
    WHEN 2 THEN 'it has the parts of the gameplay calculation Hit (41) with different numbers'
    WHEN 3 THEN 'it is the gameplay calculation HitAll (' || s || ') with a term left out'
    WHEN 4 THEN 'NelaQ2 has Damage = 25 but the slot spell NelaQ has ' || s
    WHEN 5 THEN concat_ws('; ', CASE WHEN s <> 25 THEN 'TooltipDamage is 25 but the gameplay calculation Damage is ' || s END, CASE WHEN s <> 30 THEN 'its AP ratio ' || r || ' is none of the spell''s coefficients (0.3)' END)
    WHEN 6 THEN 'matches no value in the input at any rank or scale'
    WHEN 8 THEN 'SlowTT is ' || r || '/0.3 but the gameplay data value Slow is 0.25/0.3'
    WHEN 9 THEN 'Total reads TooltipBase = ' || s || '.0/2.0 but the gameplay data value Base is 25.0/2.0'
    WHEN 10 THEN 'NelaQ2 has Base = 25 but the slot spell NelaQ has ' || s || '.0/' || s || '.0'
    WHEN 11 THEN 'its AD ratio ' || r || ' is none of the gameplay calculations'' AD ratios (0.25)' END AS detail,
  name AS placeholder, CASE c WHEN 0 THEN 'Damage' WHEN 1 THEN 'Total' WHEN 2 THEN 'Hit' WHEN 3 THEN 'HitAll' WHEN 4 THEN 'Damage' WHEN 5 THEN CASE WHEN s <> 25 THEN 'Damage' ELSE 'TooltipDamage' END
    WHEN 8 THEN 'Slow' WHEN 9 THEN 'TooltipBase' WHEN 10 THEN 'Base' WHEN 11 THEN 'Total' END AS value_name, k::VARCHAR AS planted_id, k::VARCHAR AS text_field, 'en_us' AS locale
FROM f WHERE rule IS NOT NULL"""


def checks_skipped(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that no rule could compare, over documents of all languages."""
    return checks.skipped(checks.compared(checks.facts(inputs(spark, d))))


SKIPPED = f"""SELECT rule, count(*) AS n FROM part, (VALUES ('name'), ('copy')) AS r(rule) WHERE p_partkey % {len(DOCS)} = 7 GROUP BY rule"""


def catch_report(spark: SparkSession, d: str) -> DataFrame:
    """How many of the documents, taken as planted errors, have a flag on their placeholder, by kind and rule."""
    c = F.col("p_partkey") % len(DOCS)
    names = F.array(*(F.lit(next(iter(x["placeholders"]), "none").lower()) for x in DOCS))
    planted = spark.read.parquet(f"{d}/part.parquet").select(
        F.col("p_partkey").cast("string").alias("id"), F.when(c < 6, "calculation").otherwise("other").alias("kind"),
        F.concat(F.lit("r"), c.cast("string")).alias("rule"), F.array(F.element_at(names, (c + 1).cast("int")), F.lit("unused")).alias("targets"),
    )
    return checks.development_report(planted, checks.check_inputs(inputs(spark, d)))


CATCH_REPORT = f"""WITH {_P}
SELECT kind, rule, count(*) FILTER (hit) AS caught, count(*) AS planted FROM (
  SELECT CASE WHEN p.c < 6 THEN 'calculation' ELSE 'other' END AS kind, 'r' || p.c AS rule, coalesce(f.rule IS NOT NULL AND p.c <> 6, false) AS hit FROM p LEFT JOIN f USING (k))
GROUP BY ROLLUP (kind, rule) HAVING kind IS NOT NULL"""

# -- scoring --------------------------------------------------------------------------------------

METHODS = {"A over N": ("A", "N"), "N over R": ("N", "R")}


def _cases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as cases, the lines of their orders as flags of three methods in seven runs, and the runs."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    key = F.col("c_custkey").cast("string")
    cases = c.select(key.alias("id"), F.concat(F.lit("1.1:en_us:"), key).alias("record_id"), F.when(F.col("c_custkey") % 4 == 0, "real").otherwise("planted").alias("set"), F.col("c_mktsegment").alias("group"), F.col("c_name").alias("answer"))
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    lines = spark.read.parquet(f"{d}/lineitem.parquet").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    match = F.when(F.col("o_custkey") % 4 == 0, F.concat(F.lit("1.1:en_us:"), "o_custkey")).otherwise(F.col("o_custkey").cast("string"))
    flags = lines.select(match.alias("match_id"), F.col("l_returnflag").alias("method"), (F.col("l_linenumber") % 3 + 1).cast("int").alias("run"), F.concat(F.lit("p"), F.col("l_partkey") % 5).alias("names"))
    return cases, flags, flags.select("method", "run").distinct()


def _results(spark: SparkSession, d: str) -> DataFrame:
    cases, flags, runs = _cases(spark, d)
    jobs = evaluate.with_key(evaluate.on_cases(cases, flags), "catch", "answer", "case_record", "text_field", "names")
    verdicts = jobs.select("key", (F.col("names") == "p3").alias("catch")).distinct()
    return evaluate.judged(cases, flags, runs, verdicts)


_JUDGED = """r AS (SELECT DISTINCT l_returnflag AS method, (l_linenumber % 3 + 1)::INT AS run FROM lineitem),
h AS (SELECT o_custkey AS k, l_returnflag AS method, (l_linenumber % 3 + 1)::INT AS run, bool_or(l_partkey % 5 = 3) AS hit FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
j AS (SELECT c_custkey::VARCHAR AS case_id, CASE WHEN c_custkey % 4 = 0 THEN 'real' ELSE 'planted' END AS "set", c_mktsegment AS "group", r.method, count(*) FILTER (hit) AS votes, count(*) AS runs, 2 * count(*) FILTER (hit) > count(*) AS caught
  FROM customer CROSS JOIN r LEFT JOIN h ON h.k = c_custkey AND h.method = r.method AND h.run = r.run GROUP BY ALL)"""


def judged_cases(spark: SparkSession, d: str) -> DataFrame:
    """Each case under each method: votes of the runs and whether most caught it."""
    return _results(spark, d)


JUDGED_CASES = f"WITH {_JUDGED} SELECT * FROM j"


def method_tests(spark: SparkSession, d: str) -> DataFrame:
    """The exact paired test of methods over planted cases."""
    return evaluate.report(_results(spark, d), METHODS)["tests"].withColumn("p", F.round("p", 9))


METHOD_TESTS = f"""WITH {_JUDGED}, t AS (SELECT * FROM (VALUES ('A over N', 'A', 'N'), ('N over R', 'N', 'R')) AS v(test, x, y)),
n AS (SELECT test, count(*) FILTER (a.caught AND b.caught) AS "both", count(*) FILTER (a.caught AND NOT b.caught) AS only_a, count(*) FILTER (b.caught AND NOT a.caught) AS only_b, count(*) FILTER (NOT a.caught AND NOT b.caught) AS neither
  FROM t JOIN j a ON a.method = x JOIN j b ON b.method = y AND b.case_id = a.case_id WHERE a."set" = 'planted' GROUP BY test),
q AS (SELECT *, least(1.0, (SELECT 2 * sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) + (only_a + only_b) * ln(0.5))) FROM range(0, least(only_a, only_b) + 1) AS g(i))) AS p FROM n)
SELECT test, "both", only_a, only_b, neither, round(p, 9) AS p, p < 0.05 AND only_a > only_b AS significant FROM q"""


def planted_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall on planted cases by method and group; the intervals are left to the tests of the statistics."""
    return evaluate.report(_results(spark, d), METHODS)["planted_recall"].select("method", "group", "k", "n", "share")


PLANTED_RECALL = f"""WITH {_JUDGED} SELECT method, "group", count(*) FILTER (caught) AS k, count(*) AS n, round(count(*) FILTER (caught) / count(*), 6) AS share
FROM j WHERE "set" = 'planted' GROUP BY ROLLUP (method, "group") HAVING method IS NOT NULL"""


def failed_calls(spark: SparkSession, d: str) -> DataFrame:
    """Event types as methods and users as records: how many of the last lines failed."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return evaluate.failed_calls(e.select(F.col("event_type").alias("method"), (F.col("user_id") % 3).alias("run"), F.col("user_id").alias("id"), F.col("event_id").alias("pos"), (F.col("value") > 12).alias("failed")))


FAILED_CALLS = """SELECT event_type AS method, user_id % 3 AS run, count(*) AS records, count(*) FILTER (failed) AS failed, count(*) FILTER (failed) > 0.05 * count(*) AS warn
FROM (SELECT event_type, user_id, coalesce(arg_max_null(value > 12, event_id), false) AS failed FROM events GROUP BY event_type, user_id) GROUP BY 1, 2"""


def _line_flags(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("method"), F.col("l_linenumber").cast("int").alias("run"), F.col("l_orderkey").cast("string").alias("id"), F.col("l_partkey").cast("string").alias("names")).distinct()


_DRAWN = """f AS (SELECT DISTINCT l_returnflag AS method, l_linenumber AS run, l_orderkey::VARCHAR AS id, l_partkey::VARCHAR AS names FROM lineitem),
d AS (SELECT method, id, names, sha256('["label","' || id || '","' || names || '"]') AS key FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY md5('7:label-draw:' || method || ':' || id || ':' || names), method, id, names) AS k FROM f WHERE run = 1) WHERE k <= 200)"""


def label_draw(spark: SparkSession, d: str) -> DataFrame:
    """At most 200 flags of the first run of each method, drawn by hash, with their keys."""
    return evaluate.sweep_sample(_line_flags(spark, d), 200, 7).select("method", "id", "names", "key")


LABEL_DRAW = f"WITH {_DRAWN} SELECT * FROM d"


def false_alarms(spark: SparkSession, d: str) -> DataFrame:
    """Precision of the drawn flags under labels that follow their names, and flags on 1000 records."""
    flags = _line_flags(spark, d)
    drawn = evaluate.sweep_sample(flags, 200, 7)
    n = F.col("names").cast("long") % 3
    labels = drawn.select("key", F.when(n == 0, "real_mismatch").when(n == 1, "cant_tell").otherwise("false_alarm").alias("label")).distinct()
    return evaluate.false_alarms(drawn, labels, flags, spark.read.parquet(f"{d}/orders.parquet").count())


FALSE_ALARMS = f"""WITH {_DRAWN}, l AS (SELECT method, names::BIGINT % 3 AS n FROM d), t AS (SELECT method, count(*) AS flags FROM f WHERE run = 1 GROUP BY method)
SELECT method, count(*) FILTER (n = 0) AS real, count(*) FILTER (n = 1) AS cant_tell, count(*) AS judged, round(count(*) FILTER (n = 0) / count(*), 6) AS precision,
  round(count(*) FILTER (n = 0) / nullif(count(*) FILTER (n <> 1), 0), 6) AS precision_sure, max(flags) AS flags, round(1000 * max(flags) / (SELECT count(*) FROM orders), 6) AS flags_per_1000
FROM l JOIN t USING (method) GROUP BY method"""


def spot_scored(spark: SparkSession, d: str) -> DataFrame:
    """Labels as verdicts, and a review of them by quality; every seventh row is left blank."""
    x = spark.read.parquet(f"{d}/labels.parquet")
    catch = F.col("doc_id") % 2 == 0
    rows = x.select(
        F.when(catch, "catch").otherwise("label").alias("check"), F.col("doc_id").alias("key"),
        F.when(catch, (F.col("toxic") == 1).cast("string")).otherwise(F.concat(F.lit("Q"), F.col("toxic"))).alias("verdict"),
        F.when(F.col("doc_id") % 7 == 0, " ").when(catch, F.when(F.col("quality") == 1, " Yes").otherwise("no ")).otherwise(F.concat(F.lit("q"), F.col("quality"))).alias("author"),
    )
    return evaluate.spot_score(rows.select("check", "key", "verdict"), rows.select("check", "key", "author")).withColumn("share", F.round("share", 6))


SPOT_SCORED = """SELECT CASE WHEN doc_id % 2 = 0 THEN 'catch' ELSE 'label' END AS "check", count(*) FILTER (toxic = quality) AS agree, count(*) AS n, round(count(*) FILTER (toxic = quality) / count(*), 6) AS share
FROM labels WHERE doc_id % 7 <> 0 GROUP BY 1"""

QUERIES = {f.__name__: f for f in (check_flags, checks_skipped, catch_report, judged_cases, method_tests, planted_recall, failed_calls, label_draw, false_alarms, spot_scored)}
SQL = {"check_flags": CHECK_FLAGS, "checks_skipped": SKIPPED, "catch_report": CATCH_REPORT, "judged_cases": JUDGED_CASES, "method_tests": METHOD_TESTS, "planted_recall": PLANTED_RECALL, "failed_calls": FAILED_CALLS, "label_draw": LABEL_DRAW, "false_alarms": FALSE_ALARMS, "spot_scored": SPOT_SCORED}


# -- from entity files to flags ---------------------------------------------------------------------


def entity_objects(spark: SparkSession, d: str) -> DataFrame:
    """(folder, path, obj): an entity file for each part, with a record and the two spells of one ability, one of them hashed."""
    p = spread(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size"))
    k, s = F.col("p_partkey"), F.col("p_size")
    name = F.concat(F.lit("Unit"), k.cast("string"))
    home = F.concat(F.lit("Characters/"), name, F.lit("/Spells/"), name)
    put = lambda template, **values: _filled(F.lit(template), values)
    record = put('{"__type":"CharacterRecord","mCharacterName":"$name","spells":["$homeQ"],"mAbilities":["ability"]}', name=name, home=home)
    ability = put('{"__type":"AbilityObject","mRootSpell":"$homeQ","mChildSpells":["$homeHit"]}', home=home)
    parts = lambda value: '[{"__type":"NamedDataValueCalculationPart","mDataValue":"' + value + '"},{"__type":"StatByCoefficientCalculationPart","mCoefficient":0.5}]'
    calcs = '{"Total":{"__type":"GameCalculation","mFormulaParts":' + parts("Base") + '},"TooltipTotal":{"__type":"GameCalculation","tooltipOnly":true,"mFormulaParts":' + parts("TooltipBase") + "}}"
    values = '[{"name":"Base","values":[0,$a,$b,$c]},{"name":"TooltipBase","values":[0,$a,$b,$z]}]'
    shown = '{"mTooltipData":{"mLocKeys":{"keyTooltip":"Spell_$nameQ_Tooltip"},"mLists":{"LevelUp":{"levelCount":3}}}}'
    q = put('{"__type":"SpellObject","mScriptName":"$nameQ","mSpell":{"DataValues":' + values + ',"mSpellCalculations":' + calcs + ',"mClientData":' + shown + "}}", name=name, a=s, b=s + 25, c=s + 50, z=s + 50 + F.when(k % 3 == 0, 5).otherwise(0))
    hit = put('{"__type":"SpellObject","mScriptName":"$nameHit","mSpell":{"mClientData":{"mTooltipData":{"mLocKeys":{"keyTooltip":"hit_$name"}}}}}', name=name)
    rows = F.array(
        F.struct(F.concat(F.lit("Characters/"), name, F.lit("/CharacterRecords/Root")).alias("path"), record.alias("obj")),
        F.struct(F.lit("ability").alias("path"), ability.alias("obj")),
        F.struct(F.concat(home, F.lit("Q")).alias("path"), q.alias("obj")),
        F.struct(F.when(k % 2 == 0, hashing.fnv1a(F.concat(home, F.lit("Hit")))).otherwise(F.concat(home, F.lit("Hit"))).alias("path"), hit.alias("obj")),
    )
    return p.select(F.lower(name).alias("folder"), F.explode(rows).alias("r")).select("folder", "r.*")


def _filled(template, values):
    for name, value in sorted(values.items(), key=lambda x: -len(x[0])):
        template = F.replace(template, F.lit(f"${name}"), value.cast("string"))
    return template


def entity_flags(spark: SparkSession, d: str) -> DataFrame:
    """Entity files through slots, records, documents and checks: one flag for each text whose tooltip calculation differs, and one for its typed number."""
    objects = entity_objects(spark, d)
    jobs, lines = assemble.entity_tables(objects, {0: "AP"})
    texts = jobs.select("loc_key").distinct().select(
        F.lower("loc_key").alias("key"),
        F.when(F.col("loc_key").startswith("hit_"), "Hits for 1234 once.").otherwise("Deals @TooltipTotal@ and @Total@.").alias("text"),
    )
    recs = written(assemble.records(jobs, texts, patch="1.1", locale=checks.ENGLISH, stats={0: "AP"}), "records")
    groups = jobs.select(F.concat_ws(":", "folder", "spell_path").alias("key"), F.col("folder").alias("group"), F.lit("AbilityObject").alias("joined_by"))
    inputs = assemble.build_inputs(assemble.is_checked(recs), lines, groups, {0: "AP"})
    flags = checks.check_inputs(written(inputs, "inputs"))
    slots = recs.select(F.col("record_id").alias("id"), "slot", "rank_source")
    return flags.join(slots, "id").select("id", "slot", "rank_source", "check", "rule", "placeholder")


ENTITY_FLAGS = """WITH p AS (SELECT p_partkey AS k, p_size AS s, 'Unit' || p_partkey AS n FROM part)
SELECT '1.1:en_us:' || lower(n) || ':Characters/' || n || '/Spells/' || n || 'Q:keyTooltip' AS id, 'Q' AS slot, 'LevelUp list' AS rank_source, 'tooltip_calc' AS "check", 'name+copy' AS rule, 'TooltipTotal' AS placeholder FROM p WHERE k % 3 = 0
UNION ALL SELECT '1.1:en_us:' || lower(n) || ':' || CASE WHEN k % 2 = 0 THEN '{' || lpad(lower(hex(h::BIGINT)), 8, '0') || '}' ELSE 'Characters/' || n || '/Spells/' || n || 'Hit' END || ':keyTooltip',
  'Q-form', 'ability root spell''s LevelUp list', 'typed_number', 'typed_number', NULL FROM (SELECT *, list_reduce(list_concat([2166136261::UBIGINT], list_transform(string_split(lower('Characters/' || n || '/Spells/' || n || 'Hit'), ''), lambda x: ascii(x)::UBIGINT)),
    lambda a, x: (xor(a, x) * 16777619::UBIGINT) & 4294967295::UBIGINT) AS h FROM p)"""

QUERIES["entity_flags"] = entity_flags
SQL["entity_flags"] = ENTITY_FLAGS
