"""op11: archives against Python's gzip, a plain reading of pages, and damage of every kind."""

from __future__ import annotations

import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from lexaudit.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string"


def row(i=1, payload=b"<p>x</p>", kind="response", **more):
    return {"record_id": f"{warc.PAGE}{i}:00", "record_type": kind, "target_uri": "http://a/é", "refers_to": None, "payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()} | more


def packed(r):
    return b"".join(warc.member(r, "2024-01-01T00:00:00Z"))


def read(data, piece=warc.PIECE, keep=True):
    return list(warc.read_records(io.BytesIO(data), keep, piece))


@pytest.mark.parametrize("piece", [1, 7, 64, warc.PIECE])
def test_members_in_pieces_of_any_size(piece):
    r = random.Random(2)
    payloads = [b"", b"\r\n\r\n", b"WARC/1.1\r\n\r\n", bytes(r.randrange(256) for _ in range(5000)), b"a" * 3000]
    data = b"".join(packed(row(i, p)) for i, p in enumerate(payloads))
    got = read(data, piece)
    assert [x.payload for x in got] == payloads
    assert [x.problem for x in got] == [None] * 5
    assert [x.payload_digest for x in got] == [hashlib.sha1(p).hexdigest() for p in payloads]
    bare = read(data, piece, keep=False)
    assert [x.payload for x in bare] == [None] * 5
    assert [x.payload_bytes for x in bare] == [len(p) for p in payloads]
    # several records in one member, and each member is gzip that others read
    text = gzip.decompress(data)
    assert text.count(b"WARC/1.1\r\nWARC-Type: response\r\n") == 5
    assert [x.payload for x in read(gzip.compress(text), piece)] == payloads


def test_revisit_has_length_and_digest_but_no_bytes():
    big = b"z" * 2000
    r = row(3, big, "revisit", refers_to=f"{warc.PAGE}9:00")
    (got,) = read(packed(r | {"payload": None}))
    assert (got.payload_bytes, got.payload_digest, got.payload, got.problem) == (2000, hashlib.sha1(big).hexdigest(), None, None)
    assert got.fields["warc-refers-to"] == f"<{warc.PAGE}9:00>"


@pytest.mark.parametrize("piece", [1, 2, 3, 50, 997])
def test_reading_goes_on_behind_damage_in_any_piece(piece):
    r = random.Random(piece)
    parts = [packed(row(i, bytes(r.randrange(65, 91) for _ in range(3000)))) for i in range(6)]
    for k in (1, 4):
        broken = bytearray(parts[k])
        for j in r.sample(range(10, len(broken)), 30):
            broken[j] ^= 0xFF
        parts[k] = bytes(broken)
    got = read(b"".join(parts), piece)
    whole = [x.fields["warc-record-id"] for x in got if x.problem is None]
    assert whole == [f"<{warc.PAGE}{i}:00>" for i in (0, 2, 3, 5)]
    assert sum(x.problem is not None for x in got) >= 2


def test_damage_costs_its_own_record_alone():
    a, b, c = (packed(row(i, bytes([65 + i]) * 4000)) for i in range(3))
    broken = bytearray(b)
    for k in range(20, 40):
        broken[k] ^= 0x5A
    got = read(a + bytes(broken) + c)
    assert [x.problem is None for x in got] == [True, False, True]
    assert got[2].payload == b"C" * 4000
    got = read(a + b[:-30])
    assert [x.problem for x in got] == [None, "the archive ends within a member"]
    plain = gzip.decompress(b)
    assert [x.problem for x in read(a + gzip.compress(plain.replace(b"BBBB", b"BBXB", 1)) + c)] == [None, "the block digest differs", None]
    assert [x.problem for x in read(gzip.compress(plain[:-500]) + c)] == ["the block digest differs", None]
    assert [x.problem for x in read(gzip.compress(b"hello\r\n\r\nworld") + c)] == ["no WARC header", None]
    assert [x.problem for x in read(gzip.compress(plain.replace(b"Content-Length: 4", b"Content-Length: x", 2)) + c)] == ["no length", None]
    assert read(b"") == []
    assert [x.problem for x in read(b"\x1f\x8b\x08")] == ["the archive ends within a member"]


def test_records_of_others():
    """Folded fields, digests in base 16, other types, blocks that are no HTTP, a length of zero."""
    body = b"software: x\r\n"
    text = b"WARC/1.0\r\nwarc-type:  warcinfo\r\nX-Note: one\r\n two\r\nContent-Type: application/warc-fields\r\nWARC-Block-Digest: SHA-1:" + hashlib.sha1(body).hexdigest().upper().encode() + b"\r\nContent-Length: 13\r\n\r\n" + body + b"\r\n\r\n"
    text += b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    a, b = read(gzip.compress(text))
    assert (a.fields["warc-type"], a.fields["x-note"], a.payload, a.problem) == ("warcinfo", "one two", body, None)
    assert (b.fields["warc-type"], b.payload, b.problem) == ("metadata", b"", None)


def test_digest_fields():
    raw = hashlib.sha1(b"x").digest()
    assert warc.parsed_digest(warc.digest_field(raw)) == ("sha1", raw.hex())
    assert warc.parsed_digest(f"sha1:{raw.hex()}") == ("sha1", raw.hex())
    assert warc.parsed_digest("sha1:no") is None
    assert warc.parsed_digest("blake:00") is None
    assert warc.parsed_digest(None) is None


def made():
    long = "<p>" + "ä" * 600 + "</p>"
    rows = [(i, f"http://h/{i}", long) for i in range(40)] + [(100 + i, "u", "short") for i in range(3)]
    rows += [(7, "http://other", "x" * 999), (8, "again", "x" * 999), (9, "bound", "y" * 1000), (10, "bound", "y" * 1000), (10, "bound", "y" * 1000)]
    rows += [(None, None, None), (200, None, ""), (201, "http://a\r\nX: y", "n" * 1500), (None, "null id", "n" * 1500), (-5, "", "q" * 200_000)]
    return [(a, b, c, "clash") for a, b, c in rows]


def plain(rows):
    keeper = {}
    for i, _, html, _ in rows:
        p = (html or "").encode()
        if len(p) >= 1000 and i is not None:
            keeper[p] = max(keeper.get(p, i), i)
    out = []
    for i, _, html, _ in rows:
        p = (html or "").encode()
        k = keeper.get(p)
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if k is not None and k != i else "response", k if k != i else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("most_broadcast", [warc.MOST_BROADCAST, 0])
def test_pages_written_and_read_back(spark, tmp_path, most_broadcast):
    rows = made()
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    at = f"file://{tmp_path}/archives"
    warc.write_warc(warc.page_records(pages, most_broadcast=most_broadcast), at, archive_bytes=2000)
    got = warc.read_warc(spark, at)
    r = got.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("refers_to"))
    assert sorted((tuple(x) for x in r.collect()), key=str) == plain(rows)
    assert got.where("problem IS NOT NULL").isEmpty()
    back = {(x.target_uri, bytes(x.payload).decode()) for x in got.where("record_type = 'response'").collect()}
    assert ("http://a%0D%0AX: y", "n" * 1500) in back and (None, "") in back
    assert got.select(F.count_distinct("archive")).first()[0] > 3
    # what a lost task has left beside the manifest is not read; without a manifest all archives are
    (tmp_path / "archives" / "lost.warc.gz").write_bytes(packed(row(77)))
    assert warc.read_warc(spark, at, payload=False).count() == len(rows)
    (tmp_path / "archives" / warc.MANIFEST).unlink()
    assert warc.read_warc(spark, at, payload=False).count() == len(rows) + 1


def test_empty_table(spark, tmp_path):
    at = f"file://{tmp_path}/none"
    warc.write_warc(warc.page_records(spark.createDataFrame([], SCHEMA)), at)
    assert warc.read_warc(spark, at).collect() == []


def test_sql(agree):
    agree(warc.op11_warc, warc.OP11_SQL)
