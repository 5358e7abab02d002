"""Progressive JPEG in numpy: a decoder of spectral selection and successive approximation, and a payload encoder.

The decoder reads 8-bit Huffman-coded progressive files (SOF2) with one to three components, any sampling
factors, restart intervals, interleaved DC scans, end-of-band runs and refinement scans.  Scans add up in
arrays of coefficients; these are dequantised, inverse-transformed, chroma is upsampled to full resolution
and the colours become RGB.

Scans whose bits stand at places that can be computed beforehand (a Huffman table of one symbol) are read
with array operations; all others symbol by symbol.  Both write the same coefficients.

The encoder stores bytes losslessly in the format's own unit, the quantised coefficient: a block of 64
coefficients holds 64 bytes, each as 256 + byte, so that every coefficient has the same number of bits.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np

#: Natural position of the k-th coefficient in zigzag order, by the rule of the diagonals.
ZIGZAG = np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])
#: Blocks that array operations take at once.
CHUNK = 4096
#: Blocks in a row of a payload image, and block rows at most.
ROW, MOST_ROWS = 1024, 8191

_END_OF_SCAN = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")
_BASIS = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)], np.float32)


class JpegError(ValueError):
    pass


# -- Huffman tables -------------------------------------------------------------------------------


@dataclass
class Huffman:
    counts: list[int]
    symbols: list[int]
    lookup: dict[tuple[int, int], int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        code, k = 0, 0
        for length, n in enumerate(self.counts, 1):
            for _ in range(n):
                self.lookup[length, code] = self.symbols[k]
                code, k = code + 1, k + 1
            code <<= 1

    @property
    def only(self) -> int | None:
        """The symbol of a table with a single one, whose code is the bit 0."""
        return self.symbols[0] if len(self.symbols) == 1 and self.counts[0] == 1 else None

    def wide(self) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, code length) by the next 16 bits; length 0 where no code fits."""
        symbol, length = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
        for (n, code), s in self.lookup.items():
            at = code << 16 - n
            symbol[at : at + (1 << 16 - n)], length[at : at + (1 << 16 - n)] = s, n
        return symbol, length


class _Bits:
    """Reads bits of an entropy-coded segment; beyond its end come ones, as padding has them."""

    def __init__(self, data: bytes):
        self.data, self.at, self.n = data, 0, len(data) * 8

    def bit(self) -> int:
        at = self.at
        self.at += 1
        return self.data[at >> 3] >> (7 - (at & 7)) & 1 if at < self.n else 1

    def bits(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v

    def symbol(self, table: Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bit()
            if (s := table.lookup.get((length, code))) is not None:
                return s
        raise JpegError("no such Huffman code")

    def signed(self, size: int) -> int:
        v = self.bits(size)
        return v if not size or v >> size - 1 else v - (1 << size) + 1


# -- decoding -------------------------------------------------------------------------------------


@dataclass
class Component:
    id: int
    h: int
    v: int
    table: int
    wide: int = 0
    high: int = 0
    stride: int = 0
    coefs: np.ndarray | None = None


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray]
    comment: bytes = b""


def decode_coefficients(data: bytes) -> Image:
    """Coefficients (in zigzag order) of all components after all scans."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("not a JPEG")
    at, image, quant, dc, ac, restart, comment, ended = 2, None, {}, {}, {}, 0, b"", False
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            raise JpegError("no marker where one is due")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            ended = True
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                deep, name = body[k] >> 4, body[k] & 15
                n = 128 if deep else 64
                quant[name] = np.frombuffer(body[k + 1 : k + 1 + n], ">u2" if deep else "u1").astype(np.int32)
                k += 1 + n
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts = list(body[k + 1 : k + 17])
                n = sum(counts)
                (ac if body[k] >> 4 else dc)[body[k] & 15] = Huffman(counts, list(body[k + 17 : k + 17 + n]))
                k += 17 + n
        elif marker == 0xC2:
            image = _frame(body, quant)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise JpegError("not a Huffman-coded progressive JPEG")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            comment = body
        elif marker == 0xDA:
            if image is None:
                raise JpegError("a scan before the frame")
            m = _END_OF_SCAN.search(data, at)
            end = m.start() if m else len(data)
            _scan(image, body, data[at:end], dc, ac, restart)
            at = end
    if image is None:
        raise JpegError("no frame")
    if not ended:
        raise JpegError("the file is cut short")
    image.comment = comment
    return image


def _frame(body: bytes, quant: dict[int, np.ndarray]) -> Image:
    deep, height, width, n = struct.unpack(">BHHB", body[:6])
    if deep != 8 or not height or not width or n not in (1, 3):
        raise JpegError("only 8-bit images of one or three components")
    parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
    if any(not 1 <= x <= 4 for c in parts for x in (c.h, c.v)):
        raise JpegError("sampling factors are from 1 to 4")
    hmax, vmax = max(c.h for c in parts), max(c.v for c in parts)
    for c in parts:
        c.wide, c.high = -(-(-(-width * c.h // hmax)) // 8), -(-(-(-height * c.v // vmax)) // 8)
        c.stride = -(-width // (8 * hmax)) * c.h
        rows = -(-height // (8 * vmax)) * c.v
        c.coefs = np.zeros((max(rows, c.high) * max(c.stride, c.wide), 64), np.int16)
        c.stride = max(c.stride, c.wide)
    return Image(width, height, parts, quant)


def _scan(image: Image, head: bytes, data: bytes, dc: dict[int, Huffman], ac: dict[int, Huffman], restart: int) -> None:
    n = head[0]
    chosen = [(next(c for c in image.components if c.id == head[1 + 2 * i]), head[2 + 2 * i]) for i in range(n)]
    first, last, approx = head[1 + 2 * n : 4 + 2 * n]
    high, low = approx >> 4, approx & 15
    if first and n > 1 or last < first or last > 63 or not first and last:
        raise JpegError("a band that no progressive scan has")
    if n == 1:
        c = chosen[0][0]
        units = (np.arange(c.high)[:, None] * c.stride + np.arange(c.wide)).ravel()
        order = [(c, chosen[0][1], units)]
    else:
        hmax, vmax = max(c.h for c in image.components), max(c.v for c in image.components)
        across, down = -(-image.width // (8 * hmax)), -(-image.height // (8 * vmax))
        my, mx = np.divmod(np.arange(across * down), across)
        order = [(c, t, (my * c.v + y) * c.stride + mx * c.h + x) for c, t in chosen for y in range(c.v) for x in range(c.h)]
    total = len(order[0][2])
    step = restart or total
    for k, part in enumerate(_RESTART.split(data)):
        segment = part.replace(b"\xff\x00", b"\xff")
        here = [(c, t, u[k * step : (k + 1) * step]) for c, t, u in order]
        if not len(here[0][2]):
            break
        if not first:
            _dc_refine(segment, here, low) if high else _dc_first(segment, here, dc, low)
        else:
            c, t, units = here[0]
            table = ac[t & 15]
            if high:
                _ac_refine_fast(segment, c.coefs, units, first, last, low) if table.only == 0 else _ac_refine(segment, c.coefs, units, table, first, last, low)
            elif table.only is not None and table.only >> 4 == 0 and table.only:
                _ac_first_fast(segment, c.coefs, units, table.only, first, last, low)
            else:
                _ac_first(segment, c.coefs, units, table, first, last, low)


def _dc_first(data: bytes, order: list, tables: dict[int, Huffman], low: int) -> None:
    if len(order) == 1 and tables[order[0][1] >> 4].only == 0:
        return  # all differences are zero
    if len(order) > 1:
        bits, last = _Bits(data), {}
        for k in range(len(order[0][2])):
            for c, t, units in order:
                last[c.id] = last.get(c.id, 0) + bits.signed(bits.symbol(tables[t >> 4]))
                c.coefs[units[k], 0] = last[c.id] * (1 << low)
        return
    # where the next symbol begins, for every place where one might; then the chain of those that do
    c, t, units = order[0]
    symbol, length = tables[t >> 4].wide()
    raw = np.frombuffer(data + b"\xff\xff\xff\xff\xff\xff\xff", np.uint8).astype(np.uint64)
    word = sum(raw[i : len(raw) - 6 + i] << np.uint64(8 * (6 - i)) for i in range(7))[: len(data) + 1]
    places = np.arange(len(data) * 8 + 1)
    window = word[places >> 3] >> (40 - (places & 7)).astype(np.uint64)
    code = (window & np.uint64(0xFFFF)).astype(np.int64)
    size, used = symbol[code], length[code]
    nxt = (places + used + size).tolist()
    at, starts = 0, []
    end = len(nxt)
    for _ in range(len(units)):
        if at >= end:
            raise JpegError("the scan is cut short")
        starts.append(at)
        at = nxt[at]
    starts = np.array(starts)
    if not used[starts].all():
        raise JpegError("no such Huffman code")
    s = size[starts]
    begin = starts + used[starts]
    v = ((word[np.minimum(begin >> 3, len(word) - 1)] >> (56 - (begin & 7) - s).astype(np.uint64)).astype(np.int64)) & ((1 << s) - 1)
    diff = np.where((s > 0) & (v < (1 << np.maximum(s - 1, 0))), v - (1 << s) + 1, v)
    c.coefs[units, 0] = np.cumsum(diff) << low


def _dc_refine(data: bytes, order: list, low: int) -> None:
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    n = len(order[0][2])
    if len(bits) < n * len(order):
        raise JpegError("the scan is cut short")
    bits = bits[: n * len(order)].reshape(n, len(order)).astype(np.int16)
    for i, (c, _, units) in enumerate(order):
        c.coefs[units, 0] |= bits[:, i] << low


def _ac_first_fast(data: bytes, coefs: np.ndarray, units: np.ndarray, size: int, first: int, last: int, low: int) -> None:
    """Every coefficient of the band has a code of one bit and ``size`` bits."""
    k = last - first + 1
    wide = k * (1 + size)
    weights = 1 << np.arange(size - 1, -1, -1)
    for at in range(0, len(units), CHUNK):
        n = min(CHUNK, len(units) - at)
        part = np.frombuffer(data[at * wide // 8 : -(-(at + n) * wide // 8)], np.uint8)
        bits = np.unpackbits(part)
        if len(bits) < n * wide:
            raise JpegError("the scan is cut short")
        bits = bits[: n * wide].reshape(n, k, 1 + size)
        if bits[:, :, 0].any():
            raise JpegError("no such Huffman code")
        if size == 8:
            v = np.packbits(bits[:, :, 1:], axis=2)[:, :, 0].astype(np.int32)
        else:
            v = bits[:, :, 1:].astype(np.int32) @ weights
        v = np.where(v >> size - 1, v, v - (1 << size) + 1)
        coefs[units[at : at + n], first : last + 1] = v << low


def _ac_first(data: bytes, coefs: np.ndarray, units: np.ndarray, table: Huffman, first: int, last: int, low: int) -> None:
    bits, run = _Bits(data), 0
    for u in units.tolist():
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            s = bits.symbol(table)
            zeros, size = s >> 4, s & 15
            if size:
                k += zeros
                if k > last:
                    raise JpegError("a coefficient beyond its band")
                coefs[u, k] = bits.signed(size) * (1 << low)
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) + bits.bits(zeros) - 1
                break


def _ac_refine_fast(data: bytes, coefs: np.ndarray, units: np.ndarray, first: int, last: int, low: int) -> None:
    """No new coefficient: each block has a code of one bit, then a bit for each non-zero coefficient."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    at = 0
    for k in range(0, len(units), CHUNK):
        own = units[k : k + CHUNK]
        band = coefs[own, first : last + 1]
        live = band != 0
        n = live.sum(axis=1)
        before = at + np.concatenate([[0], np.cumsum(n + 1)])
        if before[-1] > len(bits):
            raise JpegError("the scan is cut short")
        if bits[before[:-1]].any():
            raise JpegError("no such Huffman code")
        if live.all():
            fix = bits[at : before[-1]].reshape(len(own), -1)[:, 1:].astype(np.int16)
            band += np.where(band > 0, fix, -fix) << low
        else:
            fix = np.zeros(band.shape, np.int16)
            take = np.ones(before[-1] - at, bool)
            take[before[:-1] - at] = False
            fix[live] = bits[at : before[-1]][take]
            band += np.where(band > 0, fix, -fix) << low
        coefs[own, first : last + 1] = band
        at = int(before[-1])


def _ac_refine(data: bytes, coefs: np.ndarray, units: np.ndarray, table: Huffman, first: int, last: int, low: int) -> None:
    bits, run, one = _Bits(data), 0, 1 << low

    def correct(block: list[int], k: int) -> None:
        if bits.bit():
            block[k] += one if block[k] > 0 else -one

    for u in units.tolist():
        block, k = coefs[u].tolist(), first
        while not run and k <= last:
            s = bits.symbol(table)
            zeros, size = s >> 4, s & 15
            new = 0
            if size:
                new = one if bits.bit() else -one
            elif zeros < 15:
                run = (1 << zeros) + bits.bits(zeros)
                break
            while k <= last:
                if block[k]:
                    correct(block, k)
                elif zeros:
                    zeros -= 1
                else:
                    if new:
                        block[k] = new
                    k += 1
                    break
                k += 1
        if run:
            for k2 in range(k, last + 1):
                if block[k2]:
                    correct(block, k2)
            run -= 1
        coefs[u] = block


def to_rgb(image: Image) -> np.ndarray:
    """RGB samples (height, width, 3) of full resolution."""
    hmax, vmax = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        rows = len(c.coefs) // c.stride
        plane = np.empty((rows * 8, c.stride * 8), np.float32)
        scale = image.quant[c.table].astype(np.float32)
        step = max(1, CHUNK // c.stride)
        for at in range(0, rows, step):
            own = c.coefs[at * c.stride : (at + step) * c.stride]
            flat = np.empty((len(own), 64), np.float32)
            flat[:, ZIGZAG] = own * scale
            s = _BASIS.T @ flat.reshape(-1, 8, 8) @ _BASIS
            n = len(own) // c.stride
            plane[at * 8 : (at + n) * 8] = s.reshape(n, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(n * 8, -1)
        plane = np.clip(np.rint(plane + 128), 0, 255)
        if (c.h, c.v) != (hmax, vmax):
            if hmax % c.h or vmax % c.v:
                y = np.arange(-(-image.height // 1)) * c.v // vmax
                x = np.arange(image.width) * c.h // hmax
                plane = plane[y][:, x]
            else:
                plane = plane.repeat(vmax // c.v, axis=0).repeat(hmax // c.h, axis=1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, axis=2)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.empty((*y.shape, 3), np.uint8)
    for i, v in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
        out[:, :, i] = np.clip(np.rint(v), 0, 255)
    return out


# -- payloads -------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, name: int, length: int, symbols: list[int]) -> bytes:
    counts = [0] * 16
    counts[length - 1] = len(symbols)
    return _segment(0xC4, bytes([kind << 4 | name, *counts, *symbols]))


def _scan_of(component: int, tables: int, first: int, last: int, high: int, low: int, bits: bytes) -> bytes:
    return _segment(0xDA, bytes([1, component, tables, first, last, high << 4 | low])) + bits.replace(b"\xff", b"\xff\x00")


def _packed(bits: np.ndarray) -> bytes:
    """Bits as bytes, the last filled up with ones."""
    out = np.packbits(bits)
    if len(bits) % 8:
        out[-1] |= (1 << 8 - len(bits) % 8) - 1
    return out.tobytes()


def _fixed(values: np.ndarray, low: int, size: int) -> bytes:
    """A bit 0 and ``size`` bits for every value of every block."""
    out = []
    for at in range(0, len(values), CHUNK):
        v = values[at : at + CHUNK] >> low
        bits = np.zeros((*v.shape, 1 + size), np.uint8)
        if size == 8:
            bits[:, :, 1:] = np.unpackbits(v.astype(np.uint8)[:, :, None], axis=2)
        else:
            bits[:, :, 1:] = v[:, :, None] >> np.arange(size - 1, -1, -1) & 1
        out.append(_packed(bits.ravel()))
    return b"".join(out)


def _dc_bits(diff: np.ndarray) -> bytes:
    """Four bits for the size and then the bits of each difference."""
    a = np.abs(diff)
    size = np.where(a > 0, np.floor(np.log2(np.maximum(a, 1))).astype(np.int64) + 1, 0)
    v = np.where(diff < 0, diff + (1 << size) - 1, diff)
    bits = np.zeros((len(diff), 13), np.uint8)
    bits[:, :4] = size[:, None] >> np.arange(3, -1, -1) & 1
    place = np.arange(9)
    shift = size[:, None] - 1 - place
    bits[:, 4:] = np.where(shift >= 0, v[:, None] >> np.maximum(shift, 0) & 1, 0)
    keep = np.concatenate([np.ones((len(diff), 4), bool), shift >= 0], axis=1)
    return _packed(bits[keep])


#: What stands before the frame of every payload image: unit quantisation, and the Huffman tables.
_HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0, *[1] * 64])) + _table(0, 0, 4, list(range(10))) + _table(0, 1, 1, [0]) + _table(1, 0, 1, [8]) + _table(1, 1, 1, [0])


def encode_payload(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG whose luma coefficients are 256 + the payload's bytes, 64 a block.

    The last row of blocks is filled up with zero bytes; a comment tells the number of blocks.
    """
    if not payload or len(payload) % 64:
        raise JpegError("a payload has a positive multiple of 64 bytes")
    blocks = len(payload) // 64
    high = -(-blocks // ROW)
    wide = -(-blocks // high)
    if high > MOST_ROWS:
        raise JpegError("the payload does not fit into one image")
    values = np.zeros((wide * high, 64), np.int32)
    values[:blocks] = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    values += 256
    chroma = -(-(wide * 4) // 8), -(-(high * 4) // 8)
    frame = struct.pack(">BHHB", 8, high * 8, wide * 8, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    zero = _packed(np.zeros(chroma[0] * chroma[1], np.uint8))
    dc = values[:, 0]
    refine = []
    for at in range(0, len(values), CHUNK):
        bits = (values[at : at + CHUNK] & 1).astype(np.uint8)
        bits[:, 0] = 0  # the code of the block
        refine.append(_packed(bits.ravel()))
    return b"".join(
        [
            _HEAD,
            _segment(0xFE, struct.pack(">I", blocks)),
            _segment(0xC2, frame),
            _scan_of(1, 0x00, 0, 0, 0, 1, _dc_bits(np.diff(dc >> 1, prepend=0))),
            _scan_of(2, 0x10, 0, 0, 0, 0, zero),
            _scan_of(3, 0x10, 0, 0, 0, 0, zero),
            _scan_of(1, 0x00, 1, 5, 0, 1, _fixed(values[:, 1:6], 1, 8)),
            _scan_of(1, 0x00, 6, 63, 0, 1, _fixed(values[:, 6:], 1, 8)),
            _scan_of(1, 0x01, 1, 63, 1, 0, b"".join(refine)),
            _scan_of(1, 0x00, 0, 0, 1, 0, _packed((dc & 1).astype(np.uint8))),
            b"\xff\xd9",
        ]
    )


def payload_of(image: Image) -> bytes:
    """The payload in an image of encode_payload."""
    (blocks,) = struct.unpack(">I", image.comment)
    c = image.components[0]
    own = c.coefs.reshape(-1, c.stride, 64)[:, : c.wide].reshape(-1, 64)[:blocks]
    return (own - 256).astype(np.uint8).tobytes()
