"""op12 against comparisons of all words with all."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from lexaudit.llm import variants

SCHEMA = "doc_id long, text string, lang string, word string"


def distance_one(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % 31 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            if len(low) >= 7:
                n[low] += 1
    n = {w: k for w, k in n.items() if k >= 2}
    near = {w: [v for v in n if distance_one(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def run(spark, rows):
    df = variants.spelling_variants(spark.createDataFrame([(d, t, "en", "clash") for d, t in rows], SCHEMA))
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return [tuple(r) for r in df.collect()]


def same(spark, rows):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(run(spark, rows), key=key) == sorted(plain(rows), key=key)


def test_against_all_pairs(spark):
    """Chains of forms, ties, runs of one letter, transpositions (distance two), letters beyond ASCII, one very frequent word."""
    r = random.Random(3)
    base = ["aaaaaaaa", "aaaaaaab", "abababab", "babababa", "straßenbahn", "ÀÁÂÃÄÅÆÇ", "correction", "corerction", "×÷×÷×÷×÷"]
    rows, doc = [], 0
    for w in base:
        some = {w}
        for _ in range(12):
            i = r.randrange(len(w))
            some |= {w[:i] + w[i + 1 :], w[:i] + r.choice("abcxyzÿ") + w[i:], w[:i] + r.choice("abcxé") + w[i + 1 :]}
        for v in sorted(some):
            rows.append((doc, f"1{v.upper() if v.isascii() else v}2 " * r.choice([1, 2, 2, 3, 25, 40])))
            doc += 1
    for v, k in (("chainword", 2), ("chainwora", 2), ("chainworab", 30), ("chainwoabb", 2), ("chainword" + "x", 25), ("chainwordxy", 400), ("chainwordxyz", 5000)):
        rows.append((doc, f"{v} " * k))
        doc += 1
    rows += [(1, None), (2, ""), (None, "correction corerction nullident nullident"), (None, None), rows[0], rows[0]]
    want = plain(rows)
    assert any(w[1] and w[2] != w[1] for w in want)  # a chain of two forms at least
    same(spark, rows)


def test_very_long_runs(spark):
    """Words longer than what travels inline, one of them at the border, and one of 30,000 letters."""
    long = "".join(random.Random(1).choice("abcdefgh") for _ in range(30_000))
    edge = long[:65]
    words = [long, long[:9] + long[10:], edge, edge[:-1], edge[1:], edge[:30] + "z" + edge[31:], "a" * 5000, "a" * 4999]
    rows = [(i, f"{w} {w} . {w}") for i, w in enumerate(words)]
    n = {r[0]: r for r in run(spark, rows)}
    for w in (x for x in words if x in n):
        assert n[w][4] == sum(distance_one(w, v) for v in n), w[:20]
    same(spark, [r for r in rows if len(r[1]) < 1000])


def test_keys_are_those_of_the_texts():
    """Equal texts have equal keys, and of small words no two texts share one."""
    words = ["", "a", "aa", "ab", "abc", "abb", "bab", "ÿþa", "aaaaaab"]
    owner, key = variants.deletion_keys(words)
    text = [*words, *(t for w in words for t in dict.fromkeys(w[:i] + w[i + 1 :] for i in range(len(w))))]
    assert len(text) == len(key) == len(owner)
    by_key = {}
    for t, k in zip(text, key.tolist(), strict=True):
        assert by_key.setdefault(k, t) == t
    assert len(by_key) == len(set(text))


def test_empty_table_and_sql(spark, agree):
    assert run(spark, []) == []
    agree(variants.op12_spelling, variants.OP12_SQL)
