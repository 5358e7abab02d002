"""BPE against tiktoken, packing against its rules and an exact solver on small cases."""

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from lexaudit.llm import bpe, packing
from lexaudit.llm.bpe import SLOW, _spread, buckets_for, decode, distinct_words, encode_decode, encoded_words, gather, load_ranks, numbered_documents, pre_tokens
from lexaudit.llm.packing import Places, best_fit, complete, cuts, fillings, pack, pack_documents, sequences
from tests.conftest import SF

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
EDGES = [None, "", " ", "\n\n  x", "don't we're I'll", "é🙂漢字 mixed space", "<|endoftext|> is text", "a <|endoftext|> b<|endoftext|><|endoftext", "x<|endoftext|>", "a" * 3000, "word " * 4000, "1234567 12,5", "\x00\x01"]


def test_gather():
    data, starts = np.arange(10), np.array([0, 3, 3, 7, 10])
    assert gather(data, starts, np.array([3, 1, 0, 0, 2])).tolist() == [7, 8, 9, 0, 1, 2, 0, 1, 2, 3, 4, 5, 6]
    assert gather(data, starts, np.array([1])).tolist() == [] and gather(data, starts, np.array([], int)).tolist() == []


def test_fast_matcher():
    rnd = random.Random(9)
    find, slow = pre_tokens(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN).findall
    chars = "aZé '_-.!9٣²½\x1c\x85\xa0\u2028\n\t漢🙂ſßıʼn\u0301ªº'stmdrevl"
    for _ in range(3000):
        t = "".join(rnd.choice(chars) for _ in range(rnd.randint(0, 25)))
        assert find(t) == slow(t), t
    plain = "".join(c for c in map(chr, range(0x558)) if not SLOW.search(c))
    for pair in ("", "a", " ", "1", "'"):
        for c in plain:
            assert find(pair + c + pair) == slow(pair + c + pair)


def test_bpe(spark):
    with open(RANKS, "rb") as f:
        raw = f.read()
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(raw), special_tokens={})
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(1000 + i, t) for i, t in enumerate(EDGES)] + [(None, "no id"), (1001, "")]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((str(i), len(e := np.array(enc.encode_ordinary(t or ""), "<u4")), hashlib.sha256(e).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in [*map(tuple, docs.collect()), *rows])
    got = [encode_decode(docs, ranks_path=RANKS, block_bytes=50_000), encode_decode(extra, ranks_path=RANKS, block_bytes=500)]
    assert sorted((str(r[0]), *r[1:]) for g in got for r in g.collect()) == want
    full = {r.doc_id: r for r in encode_decode(extra.where("doc_id = 1005"), ranks_path=RANKS, with_ids=True).collect()}
    assert full[1005].decoded.decode() == EDGES[5] and decode(np.array(full[1005].ids), raw).decode() == EDGES[5]
    assert encode_decode(docs.limit(0), ranks_path=RANKS).count() == 0


def test_bpe_takes_any_id(spark):
    from datetime import date
    from decimal import Decimal

    for kind, ids in (("decimal(10,2)", [Decimal("1.50"), None]), ("date", [date(2020, 1, 2), None]), ("binary", [b"a", None]), ("struct<a:int,b:string>", [(1, "x"), None]), ("short", [3, None])):
        docs = spark.createDataFrame([(i, "some words") for i in ids], f"doc_id {kind}, text string")
        got = encode_decode(docs, ranks_path=RANKS)
        assert got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        assert sorted((str(r.doc_id), r.n_tokens) for r in got.collect()) == sorted((str(r.doc_id), 2) for r in docs.collect()), kind


def test_buckets_grow_with_the_input(spark, monkeypatch):
    docs = spark.range(100).selectExpr("id AS doc_id", "repeat('é', 1000) AS text")
    assert buckets_for(docs) == buckets_for(docs.limit(0)) == bpe.LEAST_BUCKETS
    monkeypatch.setattr(bpe, "BUCKET_BYTES", 1000)
    assert buckets_for(docs) == 200


def test_bpe_ties_its_two_readings(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string").coalesce(1)
    words = distinct_words(docs, public_tokenizers.PATTERN, 10, 1).collect()
    assert [_spread(r.words)[1] for r in words] == [b" bac"]
    data = spark.sparkContext.broadcast(open(RANKS, "rb").read())
    back = encoded_words(distinct_words(docs, public_tokenizers.PATTERN, 10, 1), data, public_tokenizers.PATTERN, 1).collect()
    assert len(back) == 1 and _spread(back[0].ids)[0].tolist() == [1, 1, 1]
    assert numbered_documents(docs, public_tokenizers.PATTERN, 10, 1).count() == 1


def test_cuts():
    assert cuts(1, 4) == [(0, 1)] and cuts(4, 4) == [(0, 4)] and cuts(5, 4) == [(0, 1), (1, 4)] and cuts(8, 4) == [(0, 4), (4, 4)]


def bins_needed(sizes, capacity):
    """Exact number of bins, by dynamic programming over subsets."""
    n = len(sizes)

    @lru_cache(None)
    def best(mask):
        if not mask:
            return (0, capacity)
        out = (n + 1, 0)
        for i in range(n):
            if mask >> i & 1:
                b, used = best(mask & ~(1 << i))
                out = min(out, (b, used + sizes[i]) if used + sizes[i] <= capacity else (b + 1, sizes[i]))
        return out

    return best((1 << n) - 1)[0]


@pytest.mark.parametrize("seed", range(12))
def test_completion_is_exact_on_small_cases(seed):
    rnd = random.Random(seed)
    sizes = [rnd.randint(5, 60) for _ in range(11)]
    counts = {s: sizes.count(s) for s in sizes}
    got = complete(counts, 100)
    used = {}
    for pattern, n in got:
        assert sum(k * c for k, c in pattern.items()) <= 100
        for k, c in pattern.items():
            used[k] = used.get(k, 0) + c * n
    assert used == counts
    assert sum(n for _, n in got) == bins_needed(tuple(sizes), 100)


def test_completion_beats_best_fit():
    counts = {60: 2, 50: 2, 40: 2, 30: 2, 20: 1}  # best fit decreasing wastes here or ties; the bound is 4
    assert sum(n for _, n in complete(counts, 100)) == -(-sum(k * n for k, n in counts.items()) // 100) <= sum(n for _, n in best_fit(counts, 100))
    assert complete({}, 100) == []


def test_fillings_are_undominated():
    counts = np.zeros(101, int)
    counts[[10, 30, 35, 40]] = 1
    assert list(fillings(40, counts)) == [[40]] and list(fillings(5, counts)) == [[]]
    assert list(fillings(45, counts)) == [[35, 10], [40]] and list(fillings(69, counts)) == [[35, 30], [40, 10]]


def all_fillings(room, sizes):
    """Every set that fits, by brute force."""
    out = {()}
    for s in sorted(sizes, reverse=True):
        out |= {(*f, s) for f in out if sum(f) + s <= room}
    return out


def covers(better, worse):
    """Whether the sizes of worse can be put into those of better, whole by whole (Martello and Toth)."""

    def fit(rest, rooms):
        if not rest:
            return True
        return any(fit(rest[1:], [*rooms[:i], r - rest[0], *rooms[i + 1 :]]) for i, r in enumerate(rooms) if r >= rest[0])

    return fit(list(worse), list(better))


@pytest.mark.parametrize("seed", range(8))
def test_fillings_are_all_that_matter(seed):
    rnd = random.Random(seed)
    sizes = [rnd.randint(3, 40) for _ in range(9)]
    room = rnd.randint(30, 70)
    counts = np.bincount(sizes, minlength=101)
    found = [tuple(f) for f in fillings(room, counts)]
    assert len(found) == len(set(found)) and [sum(f) for f in found] == sorted((sum(f) for f in found), reverse=True)
    every = all_fillings(room, sizes)
    assert set(found) <= every
    # whatever is left out is covered by one that is not
    assert all(any(covers(f, e) for f in found) for e in every)


def test_effort_bounds_the_search():
    rnd = random.Random(1)
    counts = {2 * rnd.randint(1, 1000) + 1 if i % 2 else 2 * rnd.randint(1, 1000): rnd.randint(1, 9) for i in range(900)}
    got = complete(counts, 2048, nodes=50)
    used = {}
    for pattern, n in got:
        for k, c in pattern.items():
            used[k] = used.get(k, 0) + c * n
    assert used == counts


def test_search_keeps_few_frames(monkeypatch):
    rnd = random.Random(5)
    counts = {k: rnd.randint(1, 12) for k in range(1, 2049)}
    tracemalloc.start()
    try:
        found = complete(counts, nodes=100_000)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 15_000_000
    assert Counter(k for p, n in found for k, c in p.items() for _ in range(c * n)) == Counter(counts)
    for seed in range(30):
        rnd = random.Random(seed)
        small = {rnd.randint(3, 40): rnd.randint(1, 4) for _ in range(rnd.randint(3, 12))}
        monkeypatch.setattr(packing, "LIVE", 1 << 30)
        want = [complete(small, 40, nodes) for nodes in (200, 2000, 20_000)]
        monkeypatch.setattr(packing, "LIVE", 1)
        assert [complete(small, 40, nodes) for nodes in (200, 2000, 20_000)] == want


def test_pack_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(EDGES)] + [(None, "no id"), (1001, "")], "doc_id long, text string")
    both = docs.unionByName(extra).withColumnRenamed("doc_id", "doc_id").selectExpr("*", "1 AS length", "2 AS _b")
    packed = pack_documents(both, vocabulary_path=JSON, with_ids=True)
    rows = packed.collect()
    tok = Tokenizer.from_file(JSON)
    texts = {}
    for i, t in both.select("doc_id", "text").collect():
        texts.setdefault(i, []).append(t)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4")) == r.ids_crc32 and len(r.ids) == r.length <= 2048
    for i, ts in texts.items():
        want = sorted([*tok.encode(t or "", add_special_tokens=False).ids, 0] for t in ts)
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        if len(ts) == 1:
            assert [x for p in pieces for x in p.ids] == want[0]
            assert [p.start for p in pieces] == np.cumsum([0, *(p.length for p in pieces[:-1])]).tolist()
            assert all(p.length == 2048 for p in pieces[1:])
        else:
            assert sorted(list(p.ids) for p in pieces) == want
    for s in by_seq.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0, *(r.length for r in s[:-1])]).tolist() and sum(r.length for r in s) <= 2048
    assert len(by_seq) == -(-sum(r.length for r in rows) // 2048)
    joined = {r.sequence_id: r for r in sequences(packed).collect()}
    assert all(joined[k].ids == [x for r in v for x in r.ids] for k, v in by_seq.items())
    assert pack_documents(both.limit(0), vocabulary_path=JSON).count() == 0


def test_pack_rejects_what_does_not_fit(spark):
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(1, 0, 5000)], "doc_id long, piece int, length long"))


def test_places():
    p = Places.of([({5: 2, 3: 1}, 3), ({5: 1}, 1)])
    seq, off = p.find(np.array([5] * 7 + [3] * 3), np.array([*range(7), 0, 1, 2]))
    got = sorted(zip(seq.tolist(), off.tolist(), strict=True))
    assert got == [(s, o) for s in range(3) for o in (0, 5, 10)] + [(3, 0)]
