"""PII surrogates: every detected entity gets a keyed replacement of its own kind (DataFrame functions only).

Detected are e-mail addresses, phone numbers, payment cards (Luhn), IPv4 addresses, US social security
numbers, IBANs (mod 97), keyed secrets such as ``token = "..."``, access key ids, and names after a
title; a name found so is also replaced where it stands in the same text without one.  An entity is known
by its kind and canonical form (digits of a number, without +1 before ten of them; lower case of an address
or name), so one entity written in several ways keeps one surrogate in all documents, poured into the
layout of each mention: separators, case, country code, card brand, check digits, title and script.  An
address is two entities, its own and its domain, so that addresses of one domain stay together.  A name is
one entity whatever its title and place; whether it is a given name, and of which gender, is what its
titles say over the whole corpus (neutral where they disagree or do not tell).

Surrogates are made from SHA-512 of key, kind, attempt and canonical form.  They are checked over the whole
corpus: none may equal a real entity of its kind, and no two entities of a kind may share one; those that
do are drawn again with the next attempt until none is left, so the replacement is injective.  Addresses,
domains, names and secrets grow by four letters or two syllables an attempt, so that the third attempt has
over 10^11 times as many surrogates.  Numbers of a fixed format cannot grow; one that finds no free number
in LAST_ATTEMPT attempts gets a tag with a digest in brackets, which cannot be real and ends the search.

Documents without an entity pass by untouched and are not shuffled.  Those with one are written once to the
shared folder; distinct entities are combined before their shuffle, and a hot entity meets the table of
surrogates in a merge join whose skewed side AQE can split.  Whatever of a text or an entity is written is
encrypted (AES) with a key drawn for the run, and joins go by digests.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.llm._util import free_name, written

#: Titles that announce a name, by gender (m, f, or n where the title does not tell).  Fixed values.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "г-н", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "г-жа", "Κυρία"),
    "n": ("Dr", "Prof"),
}
_ANY_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=lambda t: (-len(t), t)))
_PART = r"\p{Lu}[\p{Ll}'’]{1,24}+"

#: Patterns by kind, in the order in which they are tried at a place.  Quantifiers are possessive or bounded.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "secret": r"(?<![\w/+-])(?=[\w/+=-]{12})(?=[_/+=-]*[A-Za-z0-9])(?<=(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?)[\w/+=-]{12,512}+|(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "card": r"(?<![\d.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d])",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d|\.\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": rf"(?<![\p{{L}}\p{{N}}-])(?:{_ANY_TITLE})\.?[  ]{_PART}(?:[ -]{_PART}){{0,2}}",
}
DETECT = "|".join(f"(?:{p})" for p in PATTERNS.values()).replace(r"([ -])", r"(?<sep>[ -])").replace(r"\1", r"\k<sep>")

_INITIALS = "".join(sorted({t[0] for ts in TITLES.values() for t in ts}))
#: What every match of DETECT has in it; a quick test that spares most texts the patterns above.
HINT = rf"(?=[@+0-9:=A{_INITIALS}])(?:@|\+[0-9]|[0-9][0-9 .()-]{{6}}|[0-9]{{2}} ?[A-Z0-9]{{4}} ?[A-Z0-9]{{3}}|[:=]\s{{0,3}}[\"']?[\w/+=-]{{12}}|AKIA|(?:{_ANY_TITLE})\.?[  ]\p{{Lu}})"

#: Syllables from which names are built, by script, and the endings that mark the gender of a given name.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo",
    "cyrillic": "ба бе бо да де до га го ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то ва ве во за зе",
    "greek": "βα βε βο δα δε δο γα γο κα κε κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε σο τα τε το φα φε φο ζα ζε",
}
ENDINGS = {
    "latin": {"given_m": "rin", "given_f": "lia", "given_n": "is", "family": "den"},
    "cyrillic": {"given_m": "рин", "given_f": "лия", "given_n": "ис", "family": "нко"},
    "greek": {"given_m": "ρης", "given_f": "λία", "given_n": "ις", "family": "δης"},
}

_KIND = r"^(?s:{})$"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum, the last digit counting once."""
    d = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5)))
    return F.aggregate(d, F.lit(0).cast("long"), lambda a, v: a + v.cast("long"))


def _mod97(x: Column) -> Column:
    """Remainder of letters and digits read as an IBAN does (A = 10 ... Z = 35)."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(_chars(x), F.lit(0).cast("long"), lambda a, c: step(a, c).cast("long"))


def _rotated(x: Column) -> Column:
    return F.concat(F.substr(x, F.lit(5)), F.substr(x, F.lit(1), F.lit(4)))


def _is(m: Column, kind: str) -> Column:
    return m.rlike(_KIND.format(PATTERNS[kind] if kind != "secret" else r"[\w/+=-]{12,512}"))


def kind_of(m: Column) -> Column:
    """Kind of a match, null for one whose check digits are wrong."""
    packed = F.regexp_replace(m, " ", "")
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(_is(m, "ip"), "ip")
        .when(_is(m, "ssn"), "ssn")
        .when(_is(m, "card"), F.when(_luhn_sum(_digits(m)) % 10 == 0, "card"))
        .when(_is(m, "phone"), "phone")
        .when(_is(m, "name"), "name")
        .when(_is(m, "iban") & (_mod97(_rotated(packed)) == 1), "iban")
        .when(_is(m, "secret"), "secret")
    )


def _name_parts(m: Column) -> Column:
    """Name tokens after the title."""
    return F.split(F.regexp_replace(m, rf"^(?:{_ANY_TITLE})\.?[  ]", ""), "[ -]")


#: What a mention says of a name: it is a given name, of a man, of a woman.
GIVEN, MALE, FEMALE = 1, 2, 4
#: Letters, and twice the syllables, by which what has no fixed format grows with each attempt.
GROWTH = 4
LAST_ATTEMPT = 16


def _mark(m: Column) -> Column:
    """GIVEN with the gender that the title tells."""
    title = F.regexp_extract(m, rf"^({_ANY_TITLE})", 1)
    return F.when(title.isin(*TITLES["m"]), F.lit(GIVEN | MALE)).when(title.isin(*TITLES["f"]), F.lit(GIVEN | FEMALE)).otherwise(F.lit(GIVEN))


def keys_of(m: Column, kind: Column) -> Column:
    """{k, mark} of the entities of a match, k being ``kind:canonical form``: one, one for each token of a name, two of an address; none if invalid."""
    parts = _name_parts(m)
    name = F.transform(parts, lambda p, i: F.struct(F.concat(F.lit("name:"), F.lower(p)).alias("k"), F.when(i == F.size(parts) - 1, F.lit(0)).otherwise(_mark(m)).alias("mark")))
    one = lambda k: F.struct(k.alias("k"), F.lit(0).alias("mark"))
    low, digits = F.lower(m), _digits(m)
    email = F.array(one(F.concat(F.lit("email:"), low)), one(F.concat(F.lit("domain:"), F.substring_index(low, "@", -1))))
    national = m.startswith("+1") & (F.length(digits) == 11)
    phone = F.when(national, F.substr(digits, F.lit(2))).when(m.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)
    canon = F.when(kind.isin("card", "ssn"), digits).when(kind == "phone", phone).when(kind == "iban", F.regexp_replace(m, " ", "")).otherwise(m)
    none = F.array().cast("array<struct<k:string,mark:int>>")
    return F.when(kind.isNull(), none).when(kind == "name", name).when(kind == "email", email).otherwise(F.array(one(F.concat(kind, F.lit(":"), canon))))


def _byte(hexes: Column, i: Column) -> Column:
    return F.conv(F.substr(hexes, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _redrawn(x: Column, hexes: Column, *, hexadecimal: Column | None = None) -> Column:
    """Every digit and letter drawn anew within its class; all else stays."""
    pick = lambda alphabet, b: F.substr(F.lit(alphabet), b % len(alphabet) + 1, F.lit(1))

    def one(c: Column, i: Column) -> Column:
        b = _byte(hexes, i)
        low, up = pick("abcdefghijklmnopqrstuvwxyz", b), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", b)
        if hexadecimal is not None:
            low, up = F.when(hexadecimal, pick("abcdef", b)).otherwise(low), F.when(hexadecimal, pick("ABCDEF", b)).otherwise(up)
        return F.when(c.rlike("[0-9]"), pick("0123456789", b)).when(c.rlike(r"\p{Lu}"), up).when(c.rlike(r"\p{L}"), low).otherwise(c)

    return F.array_join(F.transform(_chars(x), one), "")


def _built_name(kind: Column, hexes: Column, attempt: Column, script: str) -> Column:
    """Four syllables, two more an attempt, and the ending of the kind of name."""
    syllables = SYLLABLES[script].split(" ")
    table = F.array(*map(F.lit, syllables))
    end = F.create_map(*(F.lit(x) for kv in ENDINGS[script].items() for x in kv))
    chosen = F.transform(F.sequence(F.lit(0), F.lit(3) + attempt * (GROWTH // 2)), lambda i: F.element_at(table, _byte(hexes, i) % len(syllables) + 1))
    return F.concat(F.array_join(chosen, ""), F.element_at(end, kind))


def surrogate(kind: Column, canon: Column, mark: Column, attempt: Column, key: str) -> Column:
    """Surrogate, in canonical form, of an entity; that of an address is its local part."""
    hexes = F.sha2(F.concat_ws("\x00", F.lit(key), kind, attempt.cast("string"), canon), 512)
    more = _redrawn(F.repeat(F.lit("a" * GROWTH), attempt), F.sha2(F.concat(hexes, F.lit("+")), 512))
    email = F.concat(_redrawn(F.substring_index(canon, "@", 1), hexes), more)
    labels = F.split(canon, r"\.")
    sub = F.transform(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))), lambda x, i: _redrawn(x, F.sha2(F.concat(hexes, i.cast("string")), 512)))
    tld = F.element_at(F.array(F.lit("com"), F.lit("net"), F.lit("org")), _byte(hexes, F.lit(63)) % 3 + 1)
    wider = F.when(attempt > 0, F.array(more)).otherwise(F.array().cast("array<string>"))
    domain = F.array_join(F.concat(wider, sub, F.array(F.lit("example"), tld)), ".")
    octets = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i == 0, _byte(hexes, i) % 223 + 1).otherwise(_byte(hexes, i) % 254 + 1).cast("string"))
    body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), _redrawn(F.substr(canon, F.lit(2), F.length(canon) - 2), hexes))
    card = F.concat(body, ((10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    # country code: everything but the last ten digits, at least one
    code = F.when(canon.startswith("+"), F.substr(canon, F.lit(1), F.greatest(F.length(canon) - 10, F.lit(2)))).otherwise(F.lit(""))
    rest = F.substr(canon, F.length(code) + 1)
    phone = F.concat(code, (_byte(hexes, F.lit(62)) % 8 + 2).cast("string"), _redrawn(F.substr(rest, F.lit(2)), hexes))
    bban = _redrawn(F.substr(canon, F.lit(5)), hexes)
    country = F.substr(canon, F.lit(1), F.lit(2))
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(bban, country, F.lit("00")))).cast("string"), 2, "0"), bban)
    secret = F.concat(_redrawn(canon, hexes, hexadecimal=canon.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")), more)
    female, male = mark.bitwiseAND(F.lit(FEMALE)) > 0, mark.bitwiseAND(F.lit(MALE)) > 0
    role = F.when(mark == 0, "family").when(female & ~male, "given_f").when(male & ~female, "given_m").otherwise("given_n")
    by_script = {script: _built_name(role, hexes, attempt, script) for script in SYLLABLES}
    greek, cyrillic = canon.rlike(r"\p{IsGreek}"), canon.rlike(r"\p{IsCyrillic}")
    names = F.when(greek, by_script["greek"]).when(cyrillic, by_script["cyrillic"]).otherwise(by_script["latin"])
    tag = F.concat(F.lit("["), kind, F.lit(" "), F.substr(hexes, F.lit(1), F.lit(40)), F.lit("]"))
    return (
        F.when(kind == "email", email)
        .when(kind == "domain", domain)
        .when(kind == "secret", secret)
        .when(kind == "name", names)
        .when(attempt >= LAST_ATTEMPT, tag)
        .when(kind == "ip", F.array_join(octets, "."))
        .when(kind == "card", card)
        .when(kind == "ssn", F.concat(F.lit("9"), _redrawn(F.substr(canon, F.lit(2)), hexes)))
        .when(kind == "phone", phone)
        .when(kind == "iban", iban)
    )


def _poured(digits: Column, layout: Column) -> Column:
    """The digits or letters in the layout of the mention: its separators stay."""
    marks = F.transform(_chars(layout), lambda c: c.rlike("[A-Za-z0-9]").cast("int"))
    upto = lambda i: F.aggregate(F.slice(marks, 1, i + 1), F.lit(0), lambda a, v: a + v)
    return F.array_join(F.transform(_chars(layout), lambda c, i: F.when(c.rlike("[A-Za-z0-9]"), F.substr(digits, upto(i), F.lit(1))).otherwise(c)), "")


def mentions(text: Column) -> Column:
    """Array of {m, kind, keys} of all matches in the text, in order; kind is null for those with wrong check digits."""
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(DETECT), F.lit(0))).otherwise(F.array().cast("array<string>"))
    kinds = F.transform(found, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    return F.transform(kinds, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), keys_of(x["m"], x["kind"]).alias("keys")))


def rendered(x: Column, found: Column) -> Column:
    """The replacement of a mention; found maps keys to surrogates.  A mention without surrogate stays."""
    m, kind, keys = x["m"], x["kind"], F.transform(x["keys"], lambda k: k["k"])
    s = F.element_at(found, F.get(keys, F.lit(0)))
    title = F.regexp_extract(m, rf"^((?:{_ANY_TITLE})\.?[  ])", 1)
    rest = F.substr(m, F.length(title) + 1)
    joints = F.concat(F.regexp_extract_all(rest, F.lit("([ -])"), F.lit(1)), F.array(F.lit("")))
    name = F.concat(title, F.array_join(F.zip_with(F.transform(keys, lambda k: F.initcap(F.element_at(found, k))), joints, lambda a, b: F.concat(a, b)), ""))
    address = F.concat(s, F.lit("@"), F.element_at(found, F.get(keys, F.lit(1))))
    email = F.when(m == F.upper(m), F.upper(address)).otherwise(address)
    # +1 before a number of ten digits stands for itself
    national = m.startswith("+1") & (F.length(_digits(m)) == 11)
    phone = F.concat(F.when(national, F.lit("1")).otherwise(F.lit("")), F.regexp_replace(s, r"^\+", ""))
    out = (
        F.when(kind == "email", email)
        .when(kind == "name", name)
        .when(s.startswith("["), s)
        .when(kind.isin("card", "ssn", "iban"), _poured(s, m))
        .when(kind == "phone", _poured(phone, m))
        .otherwise(s)
    )
    return F.coalesce(out, m)


def _bare(piece: Column, names: Column, found: Column) -> Column:
    """A piece between mentions with the names of the text replaced where they stand as words; short ones (under three letters) stay."""

    def one(text: Column, k: Column) -> Column:
        name = F.initcap(F.substr(k, F.lit(6)))
        pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), name, F.lit(r"\E(?![\p{L}\p{N}])"))
        return F.when(F.contains(text, name), F.regexp_replace(text, pattern, F.initcap(F.element_at(found, k)))).otherwise(text)

    return F.when(F.size(names) == 0, piece).otherwise(F.aggregate(names, piece, one))


def draw_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(digest, s) of every distinct key of entities(k, mark): none real, no two alike in a kind.

    k is ``kind:canonical form``, digest its SHA-256.  mark tells what a mention says of a name (0 for all
    else); null keys are ignored.  Entities are written encrypted.
    """
    lock = F.lit(secrets.token_bytes(32))
    digest = lambda k: F.sha2(F.concat(F.lit(key), F.lit("\x00"), k), 256)
    real = entities.where("k IS NOT NULL").groupBy("k").agg(F.bit_or("mark").alias("mark"))
    real = written(real.select(digest(F.col("k")).alias("digest"), F.aes_encrypt("k", lock).alias("e"), "mark"), "entities")
    k = F.aes_decrypt("e", lock).cast("string")
    pending, done, attempt = real, None, 0
    while True:
        kind, canon = F.substring_index("k", ":", 1), F.expr("substr(k, instr(k, ':') + 1)")
        drawn = pending.withColumn("k", k).withColumn("s", surrogate(kind, canon, F.col("mark"), F.lit(attempt), key))
        drawn = written(drawn.withColumn("taken", digest(F.concat(kind, F.lit(":"), F.col("s")))).drop("k"), "drawn")
        free = drawn.join(real.select(F.col("digest").alias("taken")).hint("merge"), "taken", "left_anti")
        if done is not None:
            free = free.join(done.select("taken").hint("merge"), "taken", "left_anti")
        won = written(free.groupBy("taken").agg(F.min_by("s", "digest").alias("s"), F.min("digest").alias("digest")).select("digest", "s", "taken"), "won")
        pending = written(drawn.select("digest", "e", "mark").join(won.select("digest").hint("merge"), "digest", "left_anti"), "pending")
        done = won if done is None else done.unionByName(won)
        if pending.isEmpty():
            return done.select("digest", "s")
        attempt += 1


def replace_pii(docs: DataFrame, *, key: str, text: str = "text") -> DataFrame:
    """docs with every detected entity in text replaced by its surrogate, and n_entities appended.

    Columns keep their order; n_entities, the number of valid matches of the patterns, replaces a column of
    that name.  A null text stays null and has no entities, as have empty texts.  Rows that repeat are
    treated alike and kept.  What is detected does not depend on other rows; surrogates depend on the key
    and, through the collision check and the gender of names, on the corpus.  An empty table gives an empty one.
    The key stands in the plans as a literal, as any argument does: keep event logs as safe as the texts.
    """
    cols = [c for c in docs.columns if c.lower() != "n_entities"]
    at, fd, rid, mp, r = (free_name(docs, x) for x in ("_all", "_found", "_rid", "_map", "_row"))
    lock = F.lit(secrets.token_bytes(32))
    shape = "array<struct<m:string,kind:string,keys:array<struct<k:string,mark:int>>>>"
    seen = docs.select(*(F.col(f"`{c}`") for c in cols), mentions(F.col(text)).alias(at))
    some = F.exists(F.coalesce(F.col(at), F.array().cast(shape)), lambda x: x["kind"].isNotNull())
    clean = seen.where(~some).select(*(F.col(f"`{c}`") for c in cols), F.lit(0).cast("long").alias("n_entities"))
    closed = seen.where(some).withColumn(rid, F.monotonically_increasing_id())
    closed = closed.withColumn(at, F.aes_encrypt(F.to_json(at), lock)).withColumn(text, F.aes_encrypt(F.col(text).cast("string"), lock))
    hit = written(closed, "private").withColumn(at, F.from_json(F.aes_decrypt(at, lock).cast("string"), shape)).withColumn(text, F.aes_decrypt(text, lock).cast("string"))
    hit = hit.withColumn(fd, F.array_distinct(F.flatten(F.col(at)["keys"])))
    pairs = hit.select(F.col(rid).alias(r), F.explode(fd).alias("x")).select(r, "x.k", "x.mark")
    table = draw_surrogates(pairs.select("k", "mark"), key)
    asked = pairs.withColumn("digest", F.sha2(F.concat(F.lit(key), F.lit("\x00"), F.col("k")), 256)).dropDuplicates([r, "digest"])
    maps = asked.join(table.hint("merge"), "digest").groupBy(r).agg(F.map_from_entries(F.collect_list(F.struct("k", "s"))).alias(mp))
    j = hit.join(maps, F.col(rid) == F.col(r))
    pieces = F.split(F.col(text), DETECT, -1)
    names = F.filter(F.map_keys(mp), lambda k: k.startswith("name:") & (F.length(k) > 7))
    new = F.array_join(F.zip_with(pieces, F.col(at), lambda p, m: F.concat(_bare(p, F.array_sort(names), F.col(mp)), F.coalesce(rendered(m, F.col(mp)), F.lit("")))), "")
    n = F.size(F.filter(at, lambda x: x["kind"].isNotNull())).cast("long")
    changed = j.select(*(new.alias(c) if c == text else F.col(f"`{c}`") for c in cols), n.alias("n_entities"))
    return clean.unionByName(changed)


#: Key of the registered query and of the pipeline where the session sets none in KEY_SETTING.
DEMO_KEY = "lexaudit-demo-key"
KEY_SETTING = "spark.lexaudit.pii.key"


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, DEMO_KEY)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its private data replaced; nulls, empties, repeats and empty tables as replace_pii has them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    return replace_pii(docs, key=session_key(spark))
