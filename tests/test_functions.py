"""Text, hashing, number and statistics functions with hand-computed values."""

import pytest
import xxhash
from pyspark.sql import functions as F

from lexaudit.functions import hashing, numeric, stats, text

L = F.lit


@pytest.fixture(scope="module")
def ev(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("x")).first().x


def arr(*x):
    return F.array(*map(L, x))


def test_tokens(ev):
    t = L("Deal @A@ and @B.1*100@ x@")
    assert ev(text.tokens(t)) == ["A", "B.1*100"] and ev(text.unpaired_signs(t)) == 1
    assert [tuple(r) for r in ev(text.tokens_with_offsets(t))] == [("@A@", 5, 8), ("@B.1*100@", 13, 22)]
    assert ev(text.tokens_with_offsets(L("none"))) == [] and ev(text.includes(L("a {{ b }} {{c}}"))) == ["b", "c"]
    assert tuple(ev(text.parse_token(L("spell.Foo:Bar.2*100")))) == ("Foo", "Bar", 2, 100.0) and tuple(ev(text.parse_token(L("movement speed")))) == (None, "movement speed", None, 1.0)
    for bad in ("Bar*x", "a:b", "a<b", "", "X.y"):
        assert ev(text.parse_token(L(bad))) is None
    assert tuple(ev(text.split_rank(L("Dmg12")))) == ("Dmg", 12) and ev(text.split_rank(L("12"))) is None
    assert ev(text.fill(L("a @X@ b @Y@ @X@"), F.create_map(L("X"), L("1")))) == "a 1 b @Y@ 1"
    spans = F.array(F.struct(L(2).alias("start"), L(5).alias("end")), F.struct(L(8).alias("start"), L(11).alias("end")))
    assert ev(text.rename_tokens(L("a @X@ b @Y@ c"), spans, L("New"))) == "a @New@ b @New@ c"


def test_typed_numbers(ev):
    got = ev(text.typed_numbers(L("Gain <b>30</b>% or @X3@ 2nd 1.5x v3 &lt;5 é4 {{ 9 }} 12 %")))
    assert [(r.text, r.start, r.value) for r in got] == [("30", 8, 30.0), ("2nd", 24, 2.0), ("1.5x", 28, 1.5), ("5", 40, 5.0), ("12 %", 53, 12.0)]
    assert ev(text.around(L("0123456789"), L(4), L(6), 2)) == "234567" and ev(text.word_after(L("3 Hits now"), L(1))) == "hits"


def test_names(ev):
    base = lambda n: tuple(ev(text.base_name(L(n))))
    assert base("TooltipDamageTT_Display") == ("damage", True) and base("Tooltip") == ("tooltip", False) and base("Damage") == ("damage", False)
    assert ev(text.camel_words(L("TotalAPDamage2x"))) == ["total", "ap", "damage", "2", "x"] and ev(text.related(L("TotalDamage"), L("DamageMax"), ["total"]))
    assert not ev(text.related(L("TotalA"), L("TotalB"), ["total"])) and ev(text.name_link(L("TotalDamage"), L("damage"))) and not ev(text.name_link(L("abc"), L("ab")))
    assert ev(text.name_continues(L("ToraWDetonate"), L("ToraW"))) and not ev(text.name_continues(L("MoranRun"), L("MoranR")))
    assert ev(text.plain_name(L("spell.X:Foo.1*100"))) == "Foo" and ev(text.path_name(L("a/b/c"))) == "c"
    assert ev(text.short_key(L("mNumber"), {})) == "Number" and ev(text.short_key(L("mx"), {})) == "mx" and ev(text.short_key(L("a"), {"a": "z"})) == "z"


def test_wording(ev):
    assert [ev(text.fixed(L(x), d)) for x, d in ((100.0, 0), (1.5, 2), (-0.001, 2), (2.0, 3))] == ["100", "1.5", "0", "2"] and ev(text.fixed(L(1.25), L(1))) in ("1.2", "1.3")
    assert ev(text.reduce_names(L("the @A@ and @B@ @A@"))) == "@A@ @B@" and ev(text.reduce_names(L('says "one <br>two three." here'))) == '"one two three"'
    assert ev(text.reduce_names(L("a b c d e f g h i j"))) == '"a b c d e f g h"' and ev(text.reduce_names(L("…“x y”"))) == '"x y"'
    assert ev(text.per_rank_joined(arr("40 (+50% AP)", "65 (+50% AP)"))) == "40/65 (+50% AP)" and ev(text.per_rank_joined(arr("1", "1"))) == "1" and ev(text.per_rank_joined(arr("1", "2"))) == "1/2"
    assert ev(text.once(arr(1, 1))) == 1 and ev(text.once(arr(1, 2))) is None
    assert ev(text.quote_for(L("One cat. Two dogs! Three cat?"), ["cat"])) == "One cat. ... Three cat?" and len(ev(text.quote_for(F.repeat(L("cat "), 200), ["cat"]))) == 300
    assert tuple(ev(text.classify_line(L("Fixed a tooltip typo on X")))) == ("wording", "high", "") and ev(text.classify_line(L("tooltip"))) is None and ev(text.classify_line(L("a line of no interest"))) is None
    assert ev(text.classify_line(L("Updated the description of X"))).confidence == "low"


def test_hashes(ev):
    assert ev(hashing.fnv1a(L("mSpellCalculations"))) == "{94572284}" and ev(hashing.fnv1a(L(""))) == "{811c9dc5}"
    assert ev(hashing.xxh64(L(""))) == "ef46db3751d8e999" and ev(hashing.xxh64(L("abc"))) == "44bc2cf5ad770999"
    assert ev(hashing.key_hash(L("ABC"), L(40))) == xxhash.xxh64_intdigest(b"abc") & (1 << 40) - 1
    assert len(ev(hashing.sha_key(L("a"), L(None)))) == 64 and ev(hashing.sha_key(L("a"), L("b"))) != ev(hashing.sha_key(L("a,b")))


def test_numbers(ev):
    assert ev(numeric.same_ranks(arr(1.0), arr(100.0, 100.0))) is True and ev(numeric.same_ranks(arr(1.0, 2.0), arr(1.0))) is False
    assert ev(numeric.same_ranks(arr(1.0, 2.0), arr(1.0, 2.0, 3.0))) is None and ev(numeric.same_ranks(arr(float("nan")), arr(1.0))) is None
    assert ev(numeric.grid_step(arr(5.0, 12.5))) == 0.5 and ev(numeric.grid_step(arr(0.123))) is None
    assert ev(numeric.scaled(arr(10.0, 16.0), L(0.5))) == [5.0, 8.0] and ev(numeric.scaled(arr(10.0, 15.0), L(0.5))) is None
    assert ev(numeric.shares(L(10), L(3))) == [4, 3, 3] and ev(numeric.decimals(L(1.25))) == 2 and ev(numeric.decimals(L(3.0))) == 0
    assert ev(numeric.number_matches(L(30.0), L(0), L(0.3))) and ev(numeric.number_matches(L(0.67), L(2), L(0.6666))) and not ev(numeric.number_matches(L(31.0), L(0), L(0.3)))
    assert ev(numeric.ranked(F.array(L(None).cast("double"), L(1.0), L(2.0)), L(5))) == 2.0 and ev(numeric.by_rank(arr(1.0, 2.0), arr(0, 9))) == [1.0, 2.0]
    assert ev(numeric.stepped(L(10.0), L(1.0), F.array(F.struct(L(6).alias("level"), L(5.0).alias("bonus"), L(2.0).alias("per_level")))))[:7] == [10, 11, 12, 13, 14, 21, 23]
    assert ev(numeric.interpolated(L(10.0), L(27.0), L(False)))[17] == 27.0 and ev(numeric.close(L(1e9), L(1e9 + 1))) and not ev(numeric.close(L(0.0), L(1e-5)))


def test_statistics(ev):
    p = lambda b, c: ev(stats.mcnemar_exact(L(b), L(c)))
    assert p(5, 0) == pytest.approx(0.0625) and p(6, 0) == pytest.approx(0.03125) and p(0, 0) == 1 and p(3, 3) == 1 and p(37, 12) < 0.001
    assert p(208, 0) == pytest.approx(4.861730685829067e-63, rel=1e-9) and p(197, 2) == pytest.approx(4.953769081788918e-56, rel=1e-9)
    ci = lambda k, n: tuple(round(x, 4) for x in ev(stats.clopper_pearson(L(k), L(n))))
    assert ci(10, 10) == (0.6915, 1) and ci(12, 12)[0] == 0.7354 and ci(5, 10) == (0.1871, 0.8129) and ci(0, 0) == (0, 1) and ci(0, 10)[0] == 0
    assert ci(217, 250) == (0.8196, 0.9074) or ci(217, 250) == pytest.approx((0.820, 0.907), abs=1e-3)
    assert ev(stats.binom_cdf(L(1000), L(2000), L(0.5))) == pytest.approx(0.5089, abs=1e-4) and ev(stats.binom_cdf(L(-1), L(5), L(0.5))) == 0


def test_number_in_words(spark):
    n = text.number_in_words
    assert n("30", "he slow enemies by 30 percent for two seco") == '"enemies by 30 percent for"'
    assert n("30", "by 30 percent", 3) == '"by 30 percent"' and n("30", "xx by 30 pe") == '"by 30"'
    assert n("30", "first. Deals 30 damage. Then", 13) == '"Deals 30 damage."' and n("30", "gone") == '"30"'
    assert n("30", "a <b>x</b>30<br>more words here now", 0) == '"a x30 more words"' or n("30", "a <b>x</b>30<br>more words here now", 0).startswith('"a x30')
    df = spark.createDataFrame([('the typed number 30 in "by 30 percent"', 3), ("@A@ shows 3", None)], "names string, start int")
    from lexaudit.operators.evaluate import reduced_script_flags

    assert [r.names for r in reduced_script_flags(df).collect()] == ['"by 30 percent"', "@A@"]
