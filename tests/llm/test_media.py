"""Progressive JPEG: round trips, fast paths against the general ones, colour and sampling."""

import hashlib
import os
import zlib

import numpy as np
import pytest

from lexaudit.llm import jpeg
from lexaudit.llm.jpeg import Huffman, JpegError, decode_coefficients, encode_payload, payload_of, to_rgb
from lexaudit.llm.media import padded, store_media
from tests.conftest import SF


@pytest.mark.parametrize("blocks", [1, 2, 7, 64, 1024, 1025, 5001])
def test_round_trip(blocks):
    payload = os.urandom(blocks * 64 - 3) + bytes(3)
    image = decode_coefficients(encode_payload(payload))
    assert payload_of(image) == payload
    rgb = to_rgb(image)
    assert rgb.shape == (image.height, image.width, 3) and rgb.dtype == np.uint8


def test_fast_and_general_readers_agree(monkeypatch):
    data = encode_payload(os.urandom(64 * 37))
    fast = decode_coefficients(data)
    monkeypatch.setattr(Huffman, "only", property(lambda self: None))
    slow = decode_coefficients(data)
    for a, b in zip(fast.components, slow.components, strict=True):
        assert (a.coefs == b.coefs).all()


class Writer:
    """A plain progressive encoder for tests: any coefficients, runs of zeros, end-of-band runs, refinement."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def sym(self, s):
        self.put(s, 8) if s < 255 else self.put(0x1FE, 9)  # a table of 255 codes of 8 bits

    def size_bits(self, v):
        n = abs(v).bit_length()
        return n, (v if v >= 0 else v + (1 << n) - 1)

    def done(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def shifted(v, low):
    return int(v) >> low if v >= 0 else -(-int(v) >> low)


def ac_first(blocks, first, last, low):
    w, run = Writer(), 0

    def flush():
        nonlocal run
        while run:
            n = min(run.bit_length() - 1, 14)
            take = min(run, (1 << n + 1) - 1)
            w.sym(n << 4)
            w.put(take - (1 << n), n)
            run -= take

    for b in blocks:
        zeros = 0
        for k in range(first, last + 1):
            v = shifted(b[k], low)
            if not v:
                zeros += 1
                continue
            flush()
            while zeros > 15:
                w.sym(0xF0)
                zeros -= 16
            n, x = w.size_bits(v)
            w.sym(zeros << 4 | n)
            w.put(x, n)
            zeros = 0
        if zeros:
            run += 1
    flush()
    return w.done()


def ac_refine(blocks, first, last, low):
    w = Writer()
    for b in blocks:
        v = [abs(int(b[k])) >> low for k in range(64)]
        newest = max((k for k in range(first, last + 1) if v[k] == 1), default=-1)
        pending, zeros = [], 0
        for k in range(first, last + 1):
            if v[k] > 1:
                pending.append(v[k] & 1)
                continue
            if v[k] == 0:
                zeros += 1
                if zeros == 16 and k < newest:
                    w.sym(0xF0)
                    for x in pending:
                        w.put(x, 1)
                    pending, zeros = [], 0
                continue
            w.sym(zeros << 4 | 1)
            w.put(1 if b[k] > 0 else 0, 1)
            for x in pending:
                w.put(x, 1)
            pending, zeros = [], 0
        if zeros or pending:
            w.sym(0)
            for x in pending:
                w.put(x, 1)
    return w.done()


def dc_first(units, low):
    """units: (component, value) in scan order."""
    w, last = Writer(), {}
    for c, v in units:
        v = int(v) >> low
        n, x = w.size_bits(v - last.get(c, 0))
        last[c] = v
        w.sym(n)
        w.put(x, n)
    return w.done()


def build(width, height, comps, coefs, restart=0):
    """A file of comps (id, h, v) with an interleaved DC scan, split AC bands and a refinement pass."""
    seg, table = jpeg._segment, bytes([0, *([0] * 7), 255, *([0] * 8), *range(255)])
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(comps)]) + b"".join(bytes([i, h << 4 | v, 0]) for i, h, v in comps)
    out = [b"\xff\xd8", seg(0xE0, b"JFIF\0"), seg(0xDB, bytes([0, *([2] * 64)])), seg(0xC2, frame), seg(0xC4, table), seg(0xC4, bytes([16]) + table[1:])]
    hmax, vmax = max(c[1] for c in comps), max(c[2] for c in comps)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    units = []
    for m in range(across * down):
        my, mx = divmod(m, across)
        units.append([(i, coefs[i][my * v + y, mx * h + x, 0]) for i, h, v in comps for y in range(v) for x in range(h)])
    if restart:
        out.append(seg(0xDD, restart.to_bytes(2, "big")))
    head = bytes([len(comps), *(b for i, _, _ in comps for b in (i, 0)), 0, 0, 1])
    step = restart or len(units)
    parts = [dc_first([u for m in units[k : k + step] for u in m], 1) for k in range(0, len(units), step)]
    out.append(seg(0xDA, head) + b"".join(p + (bytes([0xFF, 0xD0 + k % 8]) if k + 1 < len(parts) else b"") for k, p in enumerate(parts)))
    if restart:
        out.append(seg(0xDD, bytes(2)))
    for i, h, v in comps:
        wide, high = -(-(-(-width * h // hmax)) // 8), -(-(-(-height * v // vmax)) // 8)
        own = coefs[i][:high, :wide].reshape(-1, 64)
        out += [seg(0xDA, bytes([1, i, 0, a, b, 1])) + ac_first(own, a, b, 1) for a, b in ((1, 5), (6, 63))]
        out.append(seg(0xDA, bytes([1, i, 0, 1, 63, 0x10])) + ac_refine(own, 1, 63, 0))
    w = Writer()
    for m in units:
        for _, v in m:
            w.put(int(v) & 1, 1)
    out.append(seg(0xDA, head[:-1] + bytes([0x10])) + w.done())
    return b"".join([*out, b"\xff\xd9"])


@pytest.mark.parametrize(("comps", "restart"), [([(1, 1, 1)], 0), ([(1, 2, 2), (2, 1, 1), (3, 1, 1)], 0), ([(1, 2, 1), (2, 1, 1), (3, 1, 1)], 3), ([(1, 1, 1), (2, 1, 1), (3, 1, 1)], 1)])
def test_general_scans(comps, restart):
    rng = np.random.default_rng(len(comps) + restart)
    width, height = 45, 27
    hmax, vmax = max(c[1] for c in comps), max(c[2] for c in comps)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    coefs = {}
    for i, h, v in comps:
        x = rng.integers(-40, 40, (down * v, across * h, 64))
        x[rng.random(x.shape) < 0.85] = 0
        x[rng.random(x.shape[:2]) < 0.3, 1:] = 0
        x[:, :, 0] = rng.integers(-200, 200, x.shape[:2])
        coefs[i] = x
    image = decode_coefficients(build(width, height, comps, coefs, restart))
    for c in image.components:
        got = c.coefs.reshape(-1, c.stride, 64)
        assert (got[: c.high, : c.wide, 1:] == coefs[c.id][: c.high, : c.wide, 1:]).all()
        n = coefs[c.id].shape
        assert len(comps) == 1 or (got[: n[0], : n[1], 0] == coefs[c.id][:, :, 0]).all()
    rgb = to_rgb(image)
    assert rgb.shape == (height, width, 3)
    # the inverse transform against its definition, on the luma of one pixel
    u = np.arange(8)
    scale = np.where(u == 0, np.sqrt(1 / 8), np.sqrt(2 / 8))
    block = np.zeros(64)
    block[jpeg.ZIGZAG] = coefs[1][1, 2] * 2
    y, x = 3, 5
    want = (block.reshape(8, 8) * np.outer(scale * np.cos((2 * y + 1) * u * np.pi / 16), scale * np.cos((2 * x + 1) * u * np.pi / 16))).sum() + 128
    if len(comps) == 1:
        assert abs(int(rgb[8 + y, 16 + x, 0]) - np.clip(want, 0, 255)) <= 1


def test_zigzag():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.ZIGZAG) == list(range(64)) and jpeg.ZIGZAG[-1] == 63


def test_errors():
    for bad in (b"", b"\xff\xd8", b"GIF89a", encode_payload(bytes(range(64)))[:-40]):
        with pytest.raises((JpegError, IndexError, KeyError, ValueError)):
            payload_of(decode_coefficients(bad))
    for bad in (b"", b"x"):
        with pytest.raises(JpegError):
            encode_payload(bad)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(None, None), (-1, ""), (-2, "é" * 100_000), (-3, "same"), (-4, "same"), (-4, "same")], "doc_id long, text string")
    both = docs.unionByName(extra).selectExpr("*", "1 AS feature", "2 AS other")
    rows = store_media(both, tensors=True).collect()
    texts = {}
    for i, t in both.select("doc_id", "text").collect():
        texts.setdefault(i, t)
    assert len(rows) == both.count() and rows[0].other == 2
    for r in rows:
        n, payload = padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (n, len(payload)) and r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and len(r.rgb) == r.height * r.width * 3
        assert payload_of(decode_coefficients(r.media)) == payload
    same = [r for r in rows if r.doc_id in (-3, -4)]
    assert len({(r.feature, r.media_sha256) for r in same}) == 1
    assert store_media(both.limit(0)).count() == 0
