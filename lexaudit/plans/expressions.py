"""A query over all classes of calculation parts, made of the rows of part, and what SQL says of them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.operators import expr

S, K = "$s$", "$k$"  # stand for the size of a part, and a hundredth of it


def _part(kind: str, **fields) -> dict:
    return {"__type": kind, **fields}


_NUMBER = lambda x: _part("NumberCalculationPart", mNumber=x)
_BASE = _part("NamedDataValueCalculationPart", mDataValue="Base")

#: One part of every class; p_partkey modulo their number tells which one a row gets.
PARTS = [
    _NUMBER(S),
    _BASE,
    _part("EffectValueCalculationPart", mEffectIndex=1),
    _part("{9e9e2e5c}", SourceObject="Other", DataValue="Far"),
    _part("SumOfSubPartsCalculationPart", mSubparts=[_NUMBER(S), _BASE]),
    _part("ProductOfSubPartsCalculationPart", mPart1=_NUMBER(3), mPart2=_BASE),
    _part("ClampSubPartsCalculationPart", mSubparts=[_BASE], mFloor=10, mCeiling=30),
    _part("StatByCoefficientCalculationPart", mCoefficient=K),
    _part("StatByNamedDataValueCalculationPart", mDataValue="Share", mStat=2, mStatFormula=2),
    _part("StatBySubPartCalculationPart", mSubpart=_NUMBER(K)),
    _part("AbilityResourceByCoefficientCalculationPart", mCoefficient=K),
    _part("BuffCounterByCoefficientCalculationPart", mBuffName="B", mCoefficient=K),
    _part("BuffCounterByNamedDataValueCalculationPart", mBuffName="B", mDataValue="Share"),
    _part("PercentageOfBuffNameElapsed", buffName="B", Coefficient=K),
    _part("ByCharLevelInterpolationCalculationPart", mStartValue=S, mEndValue=50, mScaleByStatProgressionMultiplier=True),
    _part("ByCharLevelBreakpointsCalculationPart", mLevel1Value=S, mInitialBonusPerLevel=1, mBreakpoints=[{"mLevel": 6, "mAdditionalBonusAtThisLevel": 5, "mBonusPerLevelAtAndAfter": 2}]),
    _part("ByCharLevelFormulaCalculationPart", mValues=[0, S, 60]),
    _part("{4ce08984}", **{"{91d404a5}": "Base", "{bbd778a2}": "Share", "{9823b29a}": [{"level": 3, "{ae9b464d}": "Base"}]}),
    _part("{b22609db}", **{"{91d404a5}": "Base", "{b2cd0eb0}": "Share"}),
    _part("{ee18a47b}", StartDataValue="Base", EndDataValue="Share"),
    _part("{f3cbe7b2}", mSpellCalculationKey="Inner"),
]


def _filled(tree) -> Column:
    """The tree as JSON with a row's numbers in it."""
    text = F.lit(json.dumps(tree))
    for mark, number in ((S, F.col("s")), (K, F.col("k"))):
        text = F.replace(text, F.lit(json.dumps(mark)), number.cast("string"))
    return text


def expr_parts(spark: SparkSession, d: str) -> DataFrame:
    """Every class of part at two ranks, half of them as percentages: constants, coefficients, ends of levels and display."""
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_size").cast("double").alias("s"), (F.col("p_size") / 100.0).alias("k"))
    spells = []
    for part in PARTS:
        for percent in (False, True):
            calculations = {"Total": _part("GameCalculation", mFormulaParts=[part], mDisplayAsPercent=percent), "Inner": _part("GameCalculation", mFormulaParts=[_NUMBER(S)], mMultiplier=_NUMBER(2))}
            values = [{"name": "Base", "values": [0, S, "$2s$"]}, {"name": "Share", "values": [0, K]}]
            spells.append({"mScriptName": "Main", "mSpell": {"DataValues": values, "mEffectAmount": [{"value": [0, S, 51]}], "mSpellCalculations": calculations, "mClientData": {"mTooltipData": {"mLists": {"LevelUp": {"levelCount": 2}}}}}})
    which = (F.col("p_partkey") % len(PARTS)) * 2 + F.floor(F.col("p_partkey") / len(PARTS)) % 2
    one = F.element_at(F.array(*(F.lit(json.dumps(x)) for x in spells)), (which + 1).cast("int"))
    for mark, number in ((S, F.col("s")), (K, F.col("k")), ("$2s$", F.col("s") * 2)):
        one = F.replace(one, F.lit(json.dumps(mark)), number.cast("string"))
    other = _filled({"Other": {"mScriptName": "Other", "mSpell": {"DataValues": [{"name": "Far", "values": [0, S]}]}}})
    rows = p.select(F.col("p_partkey").alias("id"), one.alias("spell"), other.alias("others"), F.lit("Total").alias("token"))
    found = expr.resolve_tokens(rows, {0: "AP", 2: "AD"})
    result = F.from_json("result", "base array<double>, level_range array<array<double>>, scalings array<struct<coefficient:array<double>,label:string>>, display array<string>")
    found = found.withColumn("r", result)
    ends = F.element_at("r.level_range", 2)
    return found.select(
        "id", "kind", "status",
        *(F.element_at("r.base", i).alias(f"base{i}") for i in (1, 2)),
        F.element_at(F.get("r.scalings", F.lit(0))["coefficient"], 2).alias("coef"),
        F.get(ends, F.lit(0)).alias("low"), F.get(ends, F.lit(1)).alias("high"),
        F.element_at("r.display", 1).alias("display"),
    )


EXPR_PARTS = f"""
WITH p AS (SELECT p_partkey AS id, p_partkey % {len(PARTS)} AS c, (p_partkey // {len(PARTS)}) % 2 = 1 AS pct, p_size::DOUBLE AS s, p_size / 100.0::DOUBLE AS k FROM part),
v AS (SELECT *, CASE WHEN pct THEN 100 ELSE 1 END AS x,
    CASE c WHEN 0 THEN s WHEN 1 THEN s WHEN 2 THEN s WHEN 3 THEN s WHEN 4 THEN s + s WHEN 5 THEN 3 * s WHEN 6 THEN least(greatest(s, 10), 30) WHEN 20 THEN 2 * s ELSE 0 END AS b1,
    CASE c WHEN 0 THEN s WHEN 1 THEN 2 * s WHEN 2 THEN 51 WHEN 3 THEN s WHEN 4 THEN 3 * s WHEN 5 THEN 6 * s WHEN 6 THEN least(greatest(2 * s, 10), 30) WHEN 20 THEN 2 * s ELSE 0 END AS b2,
    CASE c WHEN 14 THEN [s, 50] WHEN 15 THEN [s, s + 35] WHEN 16 THEN [s, 60] WHEN 17 THEN [s, 2 * s + k] WHEN 18 THEN [s, s + 17 * k] WHEN 19 THEN [s, k] END AS l1,
    CASE c WHEN 14 THEN [s, 50] WHEN 15 THEN [s, s + 35] WHEN 16 THEN [s, 60] WHEN 17 THEN [2 * s, 4 * s + k] WHEN 18 THEN [2 * s, 2 * s + 17 * k] WHEN 19 THEN [2 * s, k] END AS l2,
    CASE c WHEN 7 THEN 'AP' WHEN 8 THEN 'bonus AD' WHEN 9 THEN 'AP' WHEN 10 THEN 'max mana' WHEN 11 THEN 'per stack of buff B' WHEN 12 THEN 'per stack of buff B' WHEN 13 THEN 'of buff B elapsed' END AS what
  FROM p),
f AS (SELECT *, list_transform([b1 * x, l1[1] * x, l1[2] * x], lambda n: regexp_replace(regexp_replace(printf('%.2f', n), '0+$', ''), '\\.$', '') || CASE WHEN pct THEN '%' ELSE '' END) AS n,
    CASE WHEN c BETWEEN 7 AND 10 THEN CASE WHEN pct THEN 10000 ELSE 100 END ELSE x END AS y FROM v)
SELECT id, 'calculation' AS kind, 'resolved' AS status, round(b1 * x, 6) AS base1, round(b2 * x, 6) AS base2,
  CASE WHEN what IS NOT NULL THEN round(k, 6) END AS coef, round(l2[1] * x, 6) AS low, round(l2[2] * x, 6) AS high,
  CASE WHEN what IS NOT NULL THEN n[1] || ' (+' || regexp_replace(regexp_replace(printf('%.3f', k * y), '0+$', ''), '\\.$', '')
      || CASE WHEN y = 10000 THEN '% per 100 ' WHEN y = 100 THEN '% ' ELSE ' ' END || what || ')'
    WHEN l1 IS NOT NULL THEN n[2] || ' to ' || n[3] || ' (by level)' ELSE n[1] END AS display
FROM f"""

QUERIES = {"expr_parts": expr_parts}
SQL = {"expr_parts": EXPR_PARTS}
