"""Slots, abilities, passives, ranks and text jobs of entity files, as tables.

A file's objects become VARIANT once.  Each question about a file is a table of candidates with a rank, and the
first of each key is the answer: which object is its record, which spell is its passive, which slot a spell has.
A path is found as it is or by its hash, by two equi-joins.  Files are never brought together in one task.

Edge cases: unreadable objects are none; of names that differ in case the first path counts; a file without a
record has no slots, and its folder's name; a spell without a count has one rank.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaudit.functions.hashing import fnv1a
from lexaudit.operators.windows import first_per_key
from lexaudit.sources.shared import written

# Fixed values.
TEXT_FIELDS = ("keyTooltip", "keyTooltipExtended", "keyTooltipExtendedBelowLine", "keyTooltipSimple")
EXTENDED = TEXT_FIELDS[1:3]
SUMMARY_FIELD = "passiveToolTip"
SLOT_LETTERS = "QWER"
USUAL_ENDS = ("passive", "p")
NO_SPELL = "(passive with no spell)"
#: Where the number of ranks comes from.
OWN_LIST, ROOT_LIST, ONE_BUT_VARIES, ONE = "LevelUp list", "ability root spell's LevelUp list", "one rank, but data varies across indices 1 to 5", "none (one rank)"

SHOWN = "$.mSpell.mClientData.mTooltipData"


def field(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", path, kind)


def is_text(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def is_number(v: Column) -> Column:
    return F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")


@dataclass
class Tables:
    """What is known of the entity files: spells, their records, slots and abilities."""

    spells: DataFrame  # folder, path, low, obj, v, script
    record: DataFrame  # folder, champion, summary and what the record lists
    slots: DataFrame  # folder, low, slot
    abilities: DataFrame  # folder, low, root
    passive: DataFrame  # folder, path


def keyed(rows: DataFrame, given: str, spells: DataFrame) -> DataFrame:
    """rows with ``low``: the lower-case path under which the file has what a path names, itself or its hash."""
    known = spells.select("folder", "low").distinct()
    by_path, by_hash = (known.select("folder", F.col("low").alias(c), F.lit(True).alias(f"{c}_there")) for c in ("_low", "_hash"))
    r = rows.withColumn("_low", F.lower(given)).withColumn("_hash", F.when(~F.col(given).startswith("{"), fnv1a(F.col(given))))
    r = r.join(by_path, ["folder", "_low"], "left").join(by_hash, ["folder", "_hash"], "left")
    by_hash_only = F.col("_low_there").isNull() & F.coalesce("_hash_there", F.lit(False))
    return r.withColumn("low", F.when(by_hash_only, F.col("_hash")).otherwise(F.col("_low"))).drop("_low", "_hash", "_low_there", "_hash_there")


def _records(objects: DataFrame) -> DataFrame:
    """The record of each folder: at the usual path, under that path's hash, the only one that is a root, or the only one."""
    r = objects.where("kind = 'CharacterRecord'")
    usual = F.concat(F.lit("characters/"), F.lower("folder"), F.lit("/characterrecords/root"))
    root = F.col("path").endswith("/Root")
    count = r.groupBy("folder").agg(F.count(F.lit(1)).alias("_all"), F.count_if(root).alias("_roots"))
    rank = F.when(root & (F.col("low") == usual), 0).when(F.col("path") == fnv1a(usual), 1).when(root & (F.col("_roots") == 1), 2).when(F.col("_all") == 1, 3)
    names, paths = field("$.spellNames", "array<string>"), field("$.spells", "array<string>")
    home = F.when(F.contains("path", F.lit("/CharacterRecords/")), F.substring_index("path", "/CharacterRecords/", 1)).otherwise(F.concat(F.lit("Characters/"), "folder"))
    listed = F.when(F.size(paths) > 0, paths).otherwise(F.transform(names, lambda n: F.concat(home, F.lit("/Spells/"), n)))
    own = field("$.mCharacterName")
    found = r.join(count, "folder").select(
        "folder", "path", rank.alias("rank"), F.when(own != "", own).otherwise(F.col("folder")).alias("champion"), F.slice(listed, 1, len(SLOT_LETTERS)).alias("listed"),
        F.nullif(field("$.mCharacterPassiveSpell"), F.lit("")).alias("linked"), F.when(is_text(F.variant_get("v", "$.passiveLuaName", "variant")), field("$.passiveLuaName")).alias("lua"),
        F.when(is_text(F.variant_get("v", f"$.{SUMMARY_FIELD}", "variant")), F.nullif(field(f"$.{SUMMARY_FIELD}"), F.lit(""))).alias("summary"), field("$.mAbilities", "array<string>").alias("abilities"),
    )
    return first_per_key(found.where("rank IS NOT NULL"), ["folder"], ["rank", "path"])


def _text_keys(spells: DataFrame, *also: str) -> DataFrame:
    """(folder, path, field, key) of the text keys of all spells, with other columns of theirs."""
    keys = spells.select("folder", "path", *also, F.explode(field(f"{SHOWN}.mLocKeys", "map<string,variant>")).alias("field", "_v"))
    return keys.select("folder", "path", "field", F.when(is_text(F.col("_v")), F.try_variant_get("_v", "$", "string")).alias("key"), *also)


def _passives(spells: DataFrame, record: DataFrame, keys: DataFrame, linked: DataFrame) -> DataFrame:
    """(folder, path) of the passive of each folder, by the first way that finds one.

    The record links it (linked(folder, low)); else it has the name that the record gives, or the record's summary among
    its texts, or a usual name, or alone a usual text key.
    """
    linked = linked.join(spells.select("folder", "low", "path"), ["folder", "low"]).select("folder", "path", F.lit(0).alias("rank"))
    open_ = record.where("linked IS NULL")
    called = F.array_sort(F.array_distinct(F.array(F.lower("folder"), F.lower("champion"))))
    usual = open_.select("folder", F.posexplode(F.flatten(F.transform(called, lambda n: F.array(*(F.concat(n, F.lit(e)) for e in USUAL_ENDS))))).alias("_i", "name"))
    asked = open_.where("lua IS NOT NULL").select("folder", F.lower("lua").alias("name"), F.lit(1).alias("rank")).unionByName(usual.select("folder", "name", (F.col("_i") + 3).alias("rank")))
    named = F.array_distinct(F.transform(F.array("script", F.element_at(F.split("path", "/"), -1), field("$.ObjectName")), F.lower))
    names = spells.select("folder", "path", F.explode(named).alias("name")).where("name <> ''")
    by_name = asked.join(names, ["folder", "name"]).select("folder", "path", "rank")
    by_text = open_.where("summary IS NOT NULL").select("folder", F.col("summary").alias("key")).join(keys.where("key IS NOT NULL"), ["folder", "key"]).select("folder", "path", F.lit(2).alias("rank"))
    wanted = usual.select("folder", F.concat(F.lit("spell_"), "name", F.lit("_tooltip")).alias("key")).distinct()
    alone = keys.where(F.col("field") == TEXT_FIELDS[0]).select("folder", "path", F.lower("key").alias("key")).join(wanted, ["folder", "key"], "left_semi")
    alone = alone.groupBy("folder").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n")).where("n = 1").select("folder", "path", F.lit(99).alias("rank"))
    every = linked.unionByName(by_name).unionByName(by_text).unionByName(alone)
    return first_per_key(every, ["folder"], ["rank", "path"]).select("folder", "path")


def _members(objects: DataFrame, record: DataFrame) -> DataFrame:
    """(folder, what, a, c, given) of the paths in abilities: the root of the a-th, and its c-th member, the root before its children."""
    a = record.select("folder", F.posexplode("abilities").alias("a", "path"))
    a = a.select("folder", "a", F.posexplode(F.array("path", fnv1a(F.col("path")))).alias("rank", "at"))
    o = objects.select("folder", F.col("path").alias("at"), field("$.mRootSpell").alias("root"), field("$.mChildSpells", "array<string>").alias("children"))
    one = first_per_key(a.join(o, ["folder", "at"]), ["folder", "a"], ["rank", "at"])
    row = lambda what, c, given: F.struct(F.lit(what).alias("what"), c.alias("c"), given.alias("given"))
    members = F.concat(F.array("root"), F.coalesce("children", F.array().cast("array<string>")))
    rows = F.concat(F.array(row("root", F.lit(0), F.col("root"))), F.transform(members, lambda x, i: row("member", i, x)))
    return one.select("folder", "a", F.explode(rows).alias("r")).select("folder", "a", "r.*").where("given <> ''")


def _abilities(members: DataFrame) -> DataFrame:
    """(folder, low, root) of the spells of abilities; the first ability in the record that names a spell has it."""
    root = members.where("what = 'root'").select("folder", "a", F.col("low").alias("root"))
    child = members.where("what = 'member'").select("folder", "a", "c", "low").join(root, ["folder", "a"], "left")
    return first_per_key(child, ["folder", "low"], ["a", "c"]).select("folder", "low", "root")


def read_entities(objects: DataFrame) -> Tables:
    """The tables of objects(folder, path, obj): what each file has, looked up across its objects."""
    o = objects.where("obj IS NOT NULL").select("folder", "path", "obj", F.lower("path").alias("low"), F.try_parse_json("obj").alias("v"))
    o = written(o.where("v IS NOT NULL").withColumn("kind", field("$.__type")), "objects")
    spells = o.where("kind = 'SpellObject'").withColumn("script", F.coalesce(field("$.mScriptName"), F.lit("")))
    record = written(_records(o), "records")
    # all paths that a record or an ability gives are looked up at once
    linked = record.where("linked IS NOT NULL").select("folder", F.lit("linked").alias("what"), F.lit(0).alias("a"), F.lit(0).alias("c"), F.col("linked").alias("given"))
    listed = record.select("folder", F.lit("listed").alias("what"), F.lit(0).alias("a"), F.posexplode("listed").alias("c", "given"))
    asked = written(keyed(linked.unionByName(listed).unionByName(_members(o, record)), "given", spells), "asked")
    of = lambda what: asked.where(F.col("what") == what)
    passive = written(_passives(spells, record, _text_keys(spells), of("linked").select("folder", "low")), "passives")
    letters = F.array(*map(F.lit, SLOT_LETTERS))
    # a linked passive has its slot before what is listed, one that was looked for after it; of a path listed twice the later place counts
    given = of("linked").select("folder", "low", F.lit("P").alias("slot"), F.lit(-9).alias("rank"))
    given = given.unionByName(of("listed").select("folder", "low", F.element_at(letters, F.col("c") + 1).alias("slot"), (-F.col("c")).alias("rank")))
    given = given.unionByName(passive.select("folder", F.lower("path").alias("low"), F.lit("P").alias("slot"), F.lit(9).alias("rank")))
    slots = written(first_per_key(given, ["folder", "low"], ["rank", "slot"]).select("folder", "low", "slot"), "slots")
    return Tables(spells, record, slots, written(_abilities(asked), "abilities"), passive)


def placed(t: Tables) -> DataFrame:
    """(folder, path, low, obj, v, script, slot, root, ranks, rank_source, varies_by_rank) of all spells."""
    level = f"{SHOWN}.mLists.LevelUp.levelCount"
    number = F.try_variant_get("v", level, "variant")
    count = F.when(is_number(number) & (field(level, "double") >= 1), F.floor(field(level, "double")).cast("int"))
    # what is known of a path is gathered in narrow rows, and the spells with their objects are joined once
    places = t.slots.join(t.abilities.withColumn("_member", F.lit(True)), ["folder", "low"], "full_outer")
    root_slot = t.slots.select("folder", F.col("low").alias("root"), F.col("slot").alias("_root_slot"))
    root = t.spells.select("folder", F.col("low").alias("root"), count.alias("_root_n"))
    places = places.join(root_slot, ["folder", "root"], "left").join(root, ["folder", "root"], "left")
    s = t.spells.withColumn("_n", count).join(places, ["folder", "low"], "left").withColumn("varies_by_rank", _varying())
    s = s.withColumn("slot", F.coalesce(F.col("slot"), F.concat("_root_slot", F.lit("-form")), F.when(F.col("_member"), F.lit("ability-child")), F.lit("other")))
    n = F.coalesce("_n", "_root_n", F.lit(1))
    source = F.when(F.col("_n").isNotNull(), OWN_LIST).when(F.col("_root_n").isNotNull(), ROOT_LIST).when(F.size("varies_by_rank") > 0, ONE_BUT_VARIES).otherwise(ONE)
    s = s.withColumn("ranks", F.sequence(F.lit(1), n)).withColumn("rank_source", source)
    only = F.col("_n").isNull() & F.col("_root_n").isNull() & (F.size("varies_by_rank") > 0)
    return s.select("folder", "path", "low", "obj", "v", "script", "slot", "root", "ranks", "rank_source", F.when(only, F.col("varies_by_rank")).alias("varies_by_rank"))


def _varying() -> Column:
    """Names of the values and effects of a spell that differ between ranks 1 and 5."""
    get = F.try_variant_get
    either = lambda v, a, b, kind: F.coalesce(get(v, f"$.{a}", kind), get(v, f"$.{b}", kind))
    numbers = lambda x: F.array_distinct(F.transform(F.filter(F.slice(x, 2, 5), is_number), lambda n: get(n, "$", "double")))
    row = lambda name, x: F.struct(name.alias("name"), (F.size(numbers(x)) > 1).alias("differs"))
    values = F.transform(either("v", "mSpell.DataValues", "mSpell.mDataValues", "array<variant>"), lambda d: row(F.coalesce(either(d, "name", "mName", "string"), F.lit("?")), either(d, "values", "mValues", "array<variant>")))
    effects = F.transform(get("v", "$.mSpell.mEffectAmount", "array<variant>"), lambda e, i: row(F.concat(F.lit("effect"), (i + 1).cast("string"), F.lit("amount")), get(e, "$.value", "array<variant>")))
    none = F.array().cast("array<struct<name:string,differs:boolean>>")
    both = F.concat(F.coalesce(values, none), F.coalesce(effects, none))
    return F.transform(F.filter(both, lambda x: F.coalesce(x["differs"], F.lit(False))), lambda x: x["name"])


def text_jobs(t: Tables, spells: DataFrame) -> DataFrame:
    """(folder, champion, spell_path, script_name, slot, text_field, loc_key, ranks, rank_source, varies_by_rank, hidden) of all texts.

    spells is placed(t).  The record's summary stands in where the passive has no text of its own.
    """
    keys = _text_keys(t.spells)
    champion = t.spells.select("folder").distinct().unionByName(t.record.select("folder")).distinct().join(t.record.select("folder", "champion", "summary"), "folder", "left")
    champion = champion.select("folder", F.coalesce("champion", "folder").alias("champion"), "summary")
    own = _text_keys(spells, *(c for c in spells.columns if c not in ("folder", "path"))).where(F.col("field").startswith(TEXT_FIELDS[0]) & (F.col("key") != ""))
    told = keys.where(F.col("field") == TEXT_FIELDS[0]).join(spells.where("slot = 'P'").select("folder", "path"), ["folder", "path"], "left_semi").select("folder").distinct()
    lone = champion.where("summary IS NOT NULL").join(told, "folder", "left_anti").join(t.passive, "folder", "left")
    lone = lone.select("folder", F.coalesce("path", F.concat(F.lit("Characters/"), "folder", F.lit(f"/{NO_SPELL}"))).alias("path"), F.lit(SUMMARY_FIELD).alias("field"), F.col("summary").alias("key"))
    lone = lone.join(spells, ["folder", "path"], "left").withColumn("slot", F.lit("P")).withColumn("ranks", F.coalesce("ranks", F.array(F.lit(1)))).withColumn("rank_source", F.coalesce("rank_source", F.lit(ONE)))
    hidden = F.when(F.col("field").isin(*EXTENDED) & (field(f"{SHOWN}.EnableExtendedTooltip", "boolean") == F.lit(False)), True)
    jobs = own.unionByName(lone).join(champion.select("folder", "champion"), "folder")
    return jobs.select(
        "folder", "champion", F.col("path").alias("spell_path"), F.nullif("script", F.lit("")).alias("script_name"), "slot", F.col("field").alias("text_field"), F.col("key").alias("loc_key"),
        "ranks", "rank_source", "varies_by_rank", hidden.alias("hidden"), F.coalesce("obj", F.lit("{}")).alias("spell"),
    )
