"""Private data against a plain version that holds all entities in memory, and the limits of the surrogates."""

import hashlib
import re
from pathlib import Path

import regex
from pyspark.sql import functions as F

from lexaudit.llm import pii
from tests.conftest import SF



def plain(pattern):
    """A pattern with the classes \\d, \\w and \\s spelled out in ASCII, as the JVM reads them."""
    sets = {"d": "0-9", "w": "A-Za-z0-9_", "s": r" \t\n\x0b\f\r"}
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        i += len(c)
        inside = (inside or c == "[") and c != "]"
        name = sets.get(c[1:]) if c[0] == "\\" else None
        out.append(c if name is None else name if inside else f"[{name}]")
    return "".join(out).replace(r"\k<sep>", r"\g<sep>")


DETECT = regex.compile(plain(pii.DETECT))
TITLE = regex.compile(f"({pii._ANY_TITLE})\\.?[  ]")


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else (int(d) * 2) % 10 + int(d) // 5 for i, d in enumerate(reversed(digits)))


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def digits_of(m):
    return re.sub(r"\D", "", m)


def kind_of(m):
    full = lambda k: regex.fullmatch(plain(pii.PATTERNS[k]), m, regex.S)
    packed = m.replace(" ", "")
    if "@" in m:
        return "email"
    for k in ("ip", "ssn", "card", "phone", "name", "iban"):
        if full(k):
            if k == "card":
                return k if luhn(digits_of(m)) % 10 == 0 else None
            if k != "iban" or mod97(packed[4:] + packed[:4]) == 1:
                return k
    return "secret" if re.fullmatch(r"[\w/+=-]{12,512}", m, re.A) else None


def keys_of(m, kind):
    if kind is None:
        return []
    if kind == "name":
        title, parts = TITLE.match(m)[1], re.split("[ -]", m[TITLE.match(m).end() :])
        gender = 2 if title in pii.TITLES["m"] else 4 if title in pii.TITLES["f"] else 0
        return [("name:" + p.lower(), 0 if i == len(parts) - 1 else 1 | gender) for i, p in enumerate(parts)]
    if kind == "email":
        return [("email:" + m.lower(), 0), ("domain:" + m.lower().split("@")[-1], 0)]
    d = digits_of(m)
    canon = {"card": d, "ssn": d, "iban": m.replace(" ", ""), "phone": d[1:] if m.startswith("+1") and len(d) == 11 else "+" + d if m[0] == "+" else d}
    return [(f"{kind}:{canon.get(kind, m)}", 0)]


def sha(x):
    return hashlib.sha512(x.encode()).hexdigest()


def byte(h, i):
    return int(h[i % 64 * 2 : i % 64 * 2 + 2], 16)


def redrawn(x, h, hexadecimal=False):
    n = 6 if hexadecimal else 26
    low = "abcdefghijklmnopqrstuvwxyz"[:n]
    out = []
    for i, c in enumerate(x):
        b = byte(h, i)
        out.append("0123456789"[b % 10] if c in "0123456789" else low.upper()[b % n] if regex.match(r"\p{Lu}", c) else low[b % n] if regex.match(r"\p{L}", c) else c)
    return "".join(out)


def surrogate(k, mark, attempt, key):
    kind, canon = k.split(":", 1)
    h = sha("\x00".join([key, kind, str(attempt), canon]))
    more = redrawn("aaaa" * attempt, sha(h + "+"))
    if kind == "email":
        return redrawn(canon.split("@")[0], h) + more
    if kind == "domain":
        labels = canon.split(".")
        return ".".join([*[more] * (attempt > 0), *(redrawn(x, sha(h + str(i))) for i, x in enumerate(labels[:-2])), "example", ("com", "net", "org")[byte(h, 63) % 3]])
    if kind == "secret":
        return redrawn(canon, h, bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", canon))) + more
    if kind == "name":
        script = "greek" if regex.search(r"\p{IsGreek}", canon) else "cyrillic" if regex.search(r"\p{IsCyrillic}", canon) else "latin"
        role = "family" if not mark else {2: "given_m", 4: "given_f"}.get(mark & 6, "given_n")
        syllables = pii.SYLLABLES[script].split()
        return "".join(syllables[byte(h, i) % len(syllables)] for i in range(4 + 2 * attempt)) + pii.ENDINGS[script][role]
    if kind == "ip":
        return ".".join(str(byte(h, i) % (223 if i == 0 else 254) + 1) for i in range(4))
    if kind == "card":
        body = canon[0] + redrawn(canon[1:-1], h)
        return body + str((10 - luhn(body + "0") % 10) % 10)
    if kind == "ssn":
        return "9" + redrawn(canon[1:], h)
    if kind == "phone":
        code = canon[: max(len(canon) - 10, 2)] if canon[0] == "+" else ""
        return code + str(byte(h, 62) % 8 + 2) + redrawn(canon[len(code) + 1 :], h)
    bban = redrawn(canon[4:], h)
    return canon[:2] + f"{98 - mod97(bban + canon[:2] + '00'):02d}" + bban


def draw(marks, key):
    digest = lambda k: hashlib.sha256(f"{key}\x00{k}".encode()).hexdigest()
    found, pending, taken, attempt = {}, sorted(marks, key=digest), set(), 0
    while pending:
        here, rest = {}, []
        for k in pending:
            s = surrogate(k, marks[k], attempt, key)
            name = k.split(":")[0] + ":" + s
            if name in marks or name in taken or name in here:
                rest.append(k)
            else:
                here[name] = k
                found[k] = s
        taken |= set(here)
        pending, attempt = rest, attempt + 1
    return found


def poured(s, layout):
    it = iter(s)
    return "".join(next(it, "") if re.match("[A-Za-z0-9]", c) else c for c in layout)


def rendered(m, kind, keys, found):
    if kind is None:
        return m
    s = found[keys[0][0]]
    if kind == "email":
        a = s + "@" + found[keys[1][0]]
        return a.upper() if m == m.upper() else a
    if kind == "name":
        head = TITLE.match(m)[0]
        return head + "".join(found[k].capitalize() + j for (k, _), j in zip(keys, [*re.findall("[ -]", m[len(head) :]), ""], strict=True))
    if kind in ("card", "ssn", "iban"):
        return poured(s, m)
    if kind == "phone":
        return poured(("1" if m.startswith("+1") and len(digits_of(m)) == 11 else "") + s.lstrip("+"), m)
    return s


def brute(texts, key):
    per, marks = [], {}
    for t in texts:
        own = [(x.start(), x.end(), kind_of(x[0]), keys_of(x[0], kind_of(x[0]))) for x in DETECT.finditer(t or "")]
        per.append(own)
        for *_, keys in own:
            for k, mark in keys:
                marks[k] = marks.get(k, 0) | mark
    found, out = draw(marks, key), []
    for t, own in zip(texts, per, strict=True):
        n = sum(k is not None for _, _, k, _ in own)
        if not n:
            out.append((t, 0))
            continue
        names = sorted({k for *_, keys in own for k, _ in keys if k.startswith("name:") and len(k) > 7})

        def bare(piece, names=names):
            for k in names:
                piece = regex.sub(rf"(?<![\p{{L}}\p{{N}}]){regex.escape(k[5:].capitalize())}(?![\p{{L}}\p{{N}}])", found[k].capitalize(), piece)
            return piece

        at, parts = 0, []
        for a, b, kind, keys in own:
            parts += [bare(t[at:a]), rendered(t[a:b], kind, keys, found)]
            at = b
        out.append(("".join(parts) + bare(t[at:]), n))
    return out


HARD = [
    "Dr Anna Lee wrote; Ms Anna Lee, and Anna, and Lee again. Mr Andrea Rossi, Ms Andrea Bianchi", "Mr Bo Li and Li", "Frau Anna-Maria Keller-Lee", "г-жа Анна Петрова и Анна", "Κυρία Μαρία Παππά",
    "a@d1.com A@D1.COM b@d1.com b@x.y.d1.com", "+1 (555) 123-4567 or (555) 123-4567 or 555-123-4567, +49 30 1234567", "phone +1 (826) 555-4081 190.137.223.204 du", "4111-1111-1111-1111 4111 1111 1111 1111",
    "GB82 WEST 1234 5698 7654 32", "123-45-6789 and 123-45-6780", "token=abcdefghijkl1234 token: 0123456789ABCDEF", "", None, "no such thing 12", "10.0.0.1 10.0.0.2",
]


def test_same_as_plain_version(spark):
    texts = HARD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    want = brute(texts, "k")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: (r.text, r.n_entities) for r in pii.replace_pii(df, key="k").collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sum(n > 0 for _, n in want) > 20


def test_one_person_one_name(spark):
    df = spark.createDataFrame([(0, HARD[0]), (1, HARD[6])], "i int, text string")
    t = sorted(pii.replace_pii(df, key="k").collect())
    m = re.match(r"Dr (\w+) (\w+) wrote; Ms (\w+) (\w+), and (\w+), and (\w+) again\. Mr (\w+) \w+, Ms (\w+)", t[0].text)
    assert m[1] == m[3] == m[5] and m[2] == m[4] == m[6] and m[1].endswith("lia") and m[7] == m[8] and m[7].endswith("is")
    m = re.match(r"\+1 \((\d+)\) (\d+)-(\d+) or \((\d+)\) (\d+)-(\d+) or (\d+)-(\d+)-(\d+),", t[1].text)
    assert m.group(1, 2, 3) == m.group(4, 5, 6) == m.group(7, 8, 9)


def test_small_spaces_do_not_run_out(spark):
    df = spark.range(10_000).select(F.format_string("a@d%d.com", F.col("id")).alias("text"))
    df = df.unionByName(spark.range(200).select(F.format_string("token=---------%s--", F.chr(F.col("id") % 26 + 97)).alias("text")))
    out = pii.replace_pii(df, key="k").collect()
    mails = {r.text for r in out if "@" in r.text}
    assert len(out) == 10_200 and len(mails) == 10_000 and len({m.split("@")[1] for m in mails}) == 10_000


def test_full_formats_get_tags(spark, monkeypatch):
    monkeypatch.setattr(pii, "LAST_ATTEMPT", 1)
    e = spark.range(900).select(F.concat(F.lit("phone:+6"), F.format_string("%03d", F.col("id") + 100)).alias("k"), F.lit(0).alias("mark"))
    s = [r.s for r in pii.draw_surrogates(e, "k").collect()]
    assert len(set(s)) == 900 and any(x.startswith("[phone ") for x in s)


def test_nothing_readable_is_written(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.rglob("*.parquet/")) | set(shared.rglob("*-*"))
    pii.replace_pii(spark.createDataFrame([("Mail anna.keller@corp.example.com now",)], "text string"), key="k").collect()
    tables = [p for p in set(shared.rglob("*-*")) - before if p.is_dir()]
    assert tables
    for p in tables:
        for row in spark.read.parquet(str(p)).collect():
            assert not any("keller" in str(v).lower() for v in row)
