"""SimHash, components and the pivot index against brute force."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lexaudit.llm.graph import components
from lexaudit.llm.simhash import drop_near_duplicates, fingerprint, links, near_duplicates
from lexaudit.llm.vector_dedup import near_vectors


def slow_print(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    v = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))
    return v - (1 << 64) if v >> 63 else v


def test_fingerprints():
    for t in (None, "", " \t\n", "One", "one two", "A b C d e\x0bf É", "x " * 3000, "a b c a b c a b c"):
        assert fingerprint(t) == slow_print(t)


def test_links_are_complete(spark):
    rnd = random.Random(5)
    prints = set()
    for _ in range(40):
        b = rnd.getrandbits(64)
        for _ in range(30):
            x = b
            for _ in range(rnd.randint(0, 4)):
                x ^= 1 << rnd.randrange(64)
            prints.add(x)
    half = rnd.getrandbits(32) << 32
    prints |= {half | i for i in range(200)} | {0, (1 << 64) - 1}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    got = [(r.a, r.b) for r in links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert set(got) == want and len(got) == len(want)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, i) for i in range(101, 140)]
    rows = [*chain, *star, (200, 200), (None, 3), (4, None), (139, 100)]
    got = dict(components(spark.createDataFrame(rows, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_edges(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(5, "a b c d"), (3, "A B C D"), (9, None), (8, ""), (7, long), (6, long + " z"), (None, "a b c d"), (None, "lonely text here"), (11, "lonely words only"), (11, "lonely words only")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x"))
    got = {}
    for r in near_duplicates(df).collect():
        got.setdefault(r.doc_id, []).append(r.component_id)
    assert got[5] == got[3] == [3] and got[9] == got[8] == [8] and got[11] == [11, 11] and got[7] == got[6] == [6]
    assert sorted(got[None], key=str) == [3, None]
    kept = drop_near_duplicates(df)
    assert kept.columns == ["doc_id", "text", "fp"] and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 8, 6, 11, None, None], key=str)
    assert near_duplicates(df.limit(0)).count() == 0 and drop_near_duplicates(df.limit(0)).count() == 0


def exact(x, threshold=0.95):
    ok = [v is not None and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in x]
    u = np.array([np.array(v, float) / np.linalg.norm(v) if o else np.full(8, np.nan) for v, o in zip(x, ok, strict=True)])
    with np.errstate(invalid="ignore"):
        near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    return near


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(25, 8))
    x = [list(map(float, c + rng.normal(size=8) * s)) for c in centres for s in (0, 0, 0.05, 0.1, 0.3, 0.5)]
    x += [None, [0.0] * 8, [1.0, None, *[0.0] * 6], [float("nan"), *[1.0] * 7], [1.0] * 3, [float("inf"), *[1.0] * 7], list(x[0]), [2 * c for c in x[0]]]
    rows = [(i, v) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("k", F.lit(1))
    got = {r.vec_id: r for r in near_vectors(df, block=16).collect()}
    near = exact(x)
    links_ = near.sum(axis=1)
    assert len(got) == len(x)
    assert all(got[i].n_links <= links_[i] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.9 * links_.sum()
    for i, v in enumerate(x[150:156], 150):
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept, v
    for r in got.values():
        assert r.kept == (r.vec_id == r.component_id) and r.component_id <= r.vec_id
    assert got[0].component_id == got[1].component_id == got[156].component_id == got[157].component_id == 0


def test_vectors_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert near_vectors(spark.createDataFrame([], schema)).count() == 0
    only_bad = near_vectors(spark.createDataFrame([(1, None), (2, [0.0, 0.0])], schema)).collect()
    assert [(r.n_links, r.component_id, r.kept) for r in sorted(only_bad)] == [(0, 1, True), (0, 2, True)]
    few = near_vectors(spark.createDataFrame([(4, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [1.0, 0.01]), (None, [1.0, 0.0]), (9, [0.0, 1.0])], schema)).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in few) == [("2", 3, 2), ("2", 3, 2), ("4", 3, 2), ("9", 0, 9), ("None", 3, 2)]
