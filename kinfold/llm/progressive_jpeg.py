"""Media columns as progressive JPEG: scans are accumulated into coefficient arrays, inverse-transformed and stored as RGB.

A payload is kept losslessly in the format's own unit, quantised coefficients: byte b is the coefficient 256 + b, in zigzag
order, six 8x8 blocks to a macroblock (four Y, Cb, Cr; 4:2:0). All coefficients being in one size category, every scan has
a fixed layout, so that it is written and read by whole-array operations:
the DC planes in 1 + 8 interleaved scans (point transform 8, then one bit each), AC in one scan of point transform 4 and
4 refinements for each component. Any other progressive JPEG is read bit by bit.

A picture is one macroblock wide and holds up to TILE bytes; a longer payload is a row of pictures.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576
TILE = 2720 * UNIT

# ---- fixed values of the format ----


def _zigzag() -> np.ndarray:
    """Natural index of each zigzag position."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _dht(place: int, lengths: dict[int, list[int]]) -> bytes:
    """place: class * 16 + id. lengths: symbols by code length."""
    return _segment(0xC4, bytes([place, *(len(lengths.get(n, ())) for n in range(1, 17)), *(s for n in range(1, 17) for s in lengths.get(n, ()))]))


def _sos(comps: list[int], ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(comps), *(x for c in comps for x in (c, 0)), ss, se, ah << 4 | al]))


_TABLES = _segment(0xDB, bytes([0, *[1] * 64])) + _dht(0x00, {1: [0], 2: [1]}) + _dht(0x10, {1: [5], 2: [0]})
_REFINE = _dht(0x10, {1: [0]})  # refinements know one symbol, the end of a block, before its correction bits
_DC = [_sos([1, 2, 3], 0, 0, 0, 8), *(_sos([1, 2, 3], 0, 0, p + 1, p) for p in range(7, -1, -1))]
_AC = [_sos([c], 1, 63, 0, 4) for c in (1, 2, 3)]
_AC_MORE = [[_sos([c], 1, 63, p + 1, p) for p in (3, 2, 1, 0)] for c in (1, 2, 3)]
_COMPONENTS = bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])


def _stuff(data: bytes) -> bytes:
    return data.replace(b"\xff", b"\xff\x00")


# ---- writing ----


def _dc_first(mcus: int) -> bytes:
    """Each component's first difference is 1 (code 10, bit 1), all others 0 (code 0)."""
    bits = np.zeros(-(-(6 * mcus + 6) // 8) * 8, np.uint8)
    bits[:12] = [1, 0, 1, 0, 0, 0, 1, 0, 1, 1, 0, 1]
    bits[6 * mcus + 6 :] = 1
    return np.packbits(bits).tobytes()


def _six_bits(high: np.ndarray) -> bytes:
    """Code 0 and the five bits 1hhhh of each coefficient."""
    code = (high | 16).ravel()
    code = np.concatenate([code, np.full(-len(code) % 4, 63, np.uint8)]).reshape(-1, 4)
    out = np.empty((len(code), 3), np.uint8)
    out[:, 0] = code[:, 0] << 2 | code[:, 1] >> 4
    out[:, 1] = code[:, 1] << 4 | code[:, 2] >> 2
    out[:, 2] = code[:, 2] << 6 | code[:, 3]
    return out.tobytes()


def encode(payload: np.ndarray) -> bytes:
    """One picture of a positive multiple of UNIT bytes, at most TILE."""
    mcus = -(-len(payload) // (64 * 6))
    blocks = np.zeros(mcus * 6 * 64, np.uint8)
    blocks[: len(payload)] = payload
    blocks = blocks.reshape(mcus, 6, 64)
    out = [b"\xff\xd8", _TABLES, _segment(0xC2, b"\x08" + (16 * mcus).to_bytes(2, "big") + (16).to_bytes(2, "big") + _COMPONENTS), _DC[0], _stuff(_dc_first(mcus))]
    bits = np.unpackbits(blocks[:, :, 0].reshape(1, -1), axis=0)
    bits = np.concatenate([bits, np.ones((8, -bits.shape[1] % 8), np.uint8)], 1)
    for head, row in zip(_DC[1:], np.packbits(bits, axis=1), strict=True):
        out += [head, _stuff(row.tobytes())]
    parts = [np.ascontiguousarray(blocks[:, a:b]).reshape(-1, 64) for a, b in ((0, 4), (4, 5), (5, 6))]
    for head, x in zip(_AC, parts, strict=True):
        out += [head, _stuff(_six_bits(x[:, 1:] >> 4))]
    out.append(_REFINE)
    for heads, x in zip(_AC_MORE, parts, strict=True):
        for p, head in zip((3, 2, 1, 0), heads, strict=True):
            plane = x & np.uint8(1 << p)
            plane[:, 0] = 0
            out += [head, _stuff(np.packbits(plane).tobytes())]
    return b"".join([*out, b"\xff\xd9"])


# ---- reading ----

_NEXT = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")


@lru_cache(256)
def _quantisers(body: bytes) -> dict[int, np.ndarray]:
    out = {}
    while body:
        wide = body[0] >> 4
        raw = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8)
        out[body[0] & 15], body = raw.astype(np.int32), body[65 + 64 * wide :]
    return out


@lru_cache(256)
def _codes(body: bytes) -> dict[int, dict[tuple[int, int], int]]:
    """By table its symbols by (code length, code)."""
    out = {}
    while body:
        counts, code, k, table = body[1:17], 0, 17, {}
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                table[n, code] = body[k]
                code, k = code + 1, k + 1
            code <<= 1
        out[body[0]], body = table, body[k:]
    return out


class _Bits:
    """Reads a scan bit by bit."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), 0

    def bit(self) -> int:
        x = self.bits[self.at] if self.at < len(self.bits) else 0
        self.at += 1
        return x

    def take(self, n: int) -> int:
        x = 0
        for _ in range(n):
            x = x << 1 | self.bit()
        return x

    def symbol(self, table: dict) -> int:
        code, n = 0, 0
        while (n, code) not in table:
            code, n = code << 1 | self.bit(), n + 1
            if n > 16:
                raise ValueError("no such code")
        return table[n, code]

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x if not n or x >> (n - 1) else x - (1 << n) + 1


class Picture:
    """Coefficients by component (block rows x block columns x 64, zigzag), and what is needed to show them."""

    def __init__(self, data: bytes):
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[int, dict] = {}
        self.restart, at = 0, 2
        self.full: set[int] = set()  # components whose AC coefficients are all positive by now
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while True:
            while data[at + 1] == 0xFF:
                at += 1
            marker, at = data[at + 1], at + 2
            if marker == 0xD9:
                break
            size = int.from_bytes(data[at : at + 2], "big")
            body, at = data[at + 2 : at + size], at + size
            if marker == 0xDB:
                self.quant |= _quantisers(body)
            elif marker == 0xC4:
                self.tables |= _codes(body)
            elif marker == 0xC2:
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.comps = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])}
                self.h, self.v = max(c[0] for c in self.comps.values()), max(c[1] for c in self.comps.values())
                self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
                self.coef = {c: np.zeros((self.down * v, self.across * h, 64), np.int16) for c, (h, v, _) in self.comps.items()}
            elif 0xC0 <= marker <= 0xCF:
                raise ValueError("not a progressive Huffman JPEG")
            elif marker == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif marker == 0xDA:
                end = m.start() if (m := _NEXT.search(data, at)) else len(data)
                self._scan(body, data[at:end])
                at = end

    def _grid(self, c: int) -> tuple[int, int]:
        h, v, _ = self.comps[c]
        return -(-(-(-self.height * v // self.v)) // 8), -(-(-(-self.width * h // self.h)) // 8)

    def _scan(self, head: bytes, data: bytes) -> None:
        comps = [(head[1 + 2 * i], head[2 + 2 * i] >> 4, head[2 + 2 * i] & 15) for i in range(head[0])]
        ss, se, ah, al = head[-3], head[-2], head[-1] >> 4, head[-1] & 15
        if not self.restart and self._whole(comps, ss, se, ah, al, data.replace(b"\xff\x00", b"\xff")):
            return
        if len(comps) > 1:
            order = [(c, dc, ac, r * v + y, x * h + i) for r in range(self.down) for x in range(self.across) for c, dc, ac in comps for h, v, _ in [self.comps[c]] for y in range(v) for i in range(h)]
            every = sum(self.comps[c][0] * self.comps[c][1] for c, _, _ in comps)
        else:
            (c, dc, ac), (rows, cols) = comps[0], self._grid(comps[0][0])
            order, every = [(c, dc, ac, r, x) for r in range(rows) for x in range(cols)], 1
        pieces = re.split(rb"\xff[\xd0-\xd7]", data) if self.restart else [data]
        step = self.restart * every if self.restart else len(order)
        for k, piece in enumerate(pieces):
            self._entropy(_Bits(piece.replace(b"\xff\x00", b"\xff")), order[k * step : (k + 1) * step], ss, se, ah, al)

    def _entropy(self, bits: _Bits, order, ss, se, ah, al) -> None:
        """A scan in any layout."""
        last, run, one = {}, 0, 1 << al
        for c, dc, ac, r, x in order:
            block = self.coef[c][r, x]
            if ss == 0:
                if ah:
                    block[0] |= bits.bit() << al
                else:
                    last[c] = last.get(c, 0) + bits.signed(bits.symbol(self.tables[dc]))
                    block[0] = last[c] << al
                continue
            k = ss
            if not ah:
                if run:
                    run -= 1
                    continue
                while k <= se:
                    s = bits.symbol(self.tables[0x10 + ac])
                    zeros, n = s >> 4, s & 15
                    if n:
                        k += zeros
                        block[k] = bits.signed(n) << al
                        k += 1
                    elif zeros == 15:
                        k += 16
                    else:
                        run = (1 << zeros) + bits.take(zeros) - 1
                        break
                continue
            while k <= se and not run:
                s = bits.symbol(self.tables[0x10 + ac])
                zeros, n = s >> 4, s & 15
                new = (one if bits.bit() else -one) if n else 0
                if not n and zeros < 15:
                    run = (1 << zeros) + bits.take(zeros)
                    break
                while k <= se:
                    if block[k]:
                        if bits.bit() and not block[k] & one:
                            block[k] += one if block[k] > 0 else -one
                    elif zeros:
                        zeros -= 1
                    else:
                        if new:
                            block[k] = new
                        k += 1
                        break
                    k += 1
            if run:
                for i in range(k, se + 1):
                    if block[i] and bits.bit() and not block[i] & one:
                        block[i] += one if block[i] > 0 else -one
                run -= 1

    def _whole(self, comps, ss, se, ah, al, data: bytes) -> bool:
        """The same for scans of a fixed layout, all blocks at once. False if this scan has another."""
        raw = np.frombuffer(data, np.uint8)
        if self.across != 1:
            return False
        if ss == 0:
            n = [self.comps[c][0] * self.comps[c][1] for c, _, _ in comps]
            total = sum(n) * self.down
            if ah:
                bits = np.unpackbits(raw, count=total).reshape(self.down, -1)
            elif (n, self.tables.get(0)) == ([4, 1, 1], {(1, 0): 0, (2, 2): 1}) and data == _dc_first(self.down):
                bits = np.ones((self.down, 6), np.uint8)
            else:
                return False
            at = 0
            for (c, _, _), k in zip(comps, n, strict=True):
                self.coef[c].reshape(self.down, k, 64)[:, :, 0] |= np.left_shift(bits[:, at : at + k], al, dtype=np.int16)
                at += k
            return True
        c, _, ac = comps[0]
        block = self.coef[c].reshape(-1, 64)
        if (ss, se) != (1, 63) or self._grid(c) != self.coef[c].shape[:2]:
            return False
        table, n = self.tables[0x10 + ac], len(block)
        if not ah:
            if table.get((1, 0)) != 5 or len(raw) != -(-n * 63 // 4) * 3:
                return False
            x = raw.reshape(-1, 3)
            code = np.empty((len(x), 4), np.uint8)
            code[:, 0], code[:, 1] = x[:, 0] >> 2, (x[:, 0] & 3) << 4 | x[:, 1] >> 4
            code[:, 2], code[:, 3] = (x[:, 1] & 15) << 2 | x[:, 2] >> 6, x[:, 2] & 63
            code = code.ravel()[: n * 63].reshape(n, 63)
            if ((code & 48) != 16).any():  # another symbol, or a negative value
                return False
            np.left_shift(code, al, out=block[:, 1:], dtype=np.int16)
            self.full.add(c)
            return True
        if table.get((1, 0)) != 0 or c not in self.full or len(raw) != n * 8 or (raw[::8] & 128).any():
            return False
        bits = np.unpackbits(raw)
        bits <<= al
        block |= bits.reshape(n, 64)  # the first bit of a block is the code, 0
        return True

    def planes(self) -> list[np.ndarray]:
        """The samples of each component at full resolution. Fixed-point throughout: equal coefficients give equal samples."""
        planes = []
        for c, (h, v, q) in self.comps.items():
            rows, cols, _ = self.coef[c].shape
            plane = np.empty((rows * cols, 8, 8), np.uint8)
            coef, quant = self.coef[c].reshape(-1, 64), self.quant[q]
            for k in range(0, len(coef), BLOCKS):
                x = np.empty((len(coef[k : k + BLOCKS]), 64))
                x[:, ZIGZAG] = np.clip(coef[k : k + BLOCKS] * quant, -32768, 32767)
                # Integers throughout, whose sums stay under 2 ** 53: exact, so their order does not matter. Nothing is rounded before the end.
                x = (x.reshape(-1, 8) @ _BASIS).reshape(-1, 8, 8).transpose(0, 2, 1)
                x = (x.reshape(-1, 8) @ _BASIS).reshape(-1, 8, 8)
                plane[k : k + BLOCKS] = np.clip(np.floor(x * _DOWN + (128 + 0.5)), 0, 255).transpose(0, 2, 1)
            x = plane.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8).astype(np.int32)
            planes.append(x.repeat(self.v // v, 0).repeat(self.h // h, 1)[: self.height, : self.width])
        return planes

    def rgb(self) -> np.ndarray:
        """The full-resolution picture, height x width x 3."""
        planes = self.planes()
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
        y, cb, cr = planes[0] * 65536 + 32768, planes[1] - 128, planes[2] - 128
        out = np.empty((*y.shape, 3), np.uint8)
        for k, x in enumerate((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb)):
            out[:, :, k] = np.clip(x >> 16, 0, 255)
        return out

    def payload(self) -> np.ndarray:
        """The bytes that encode() was given."""
        parts = [self.coef[c].reshape(self.down, -1, 64) for c in (1, 2, 3)]
        x = (np.concatenate(parts, 1) - 256).astype(np.uint8).ravel()
        return x[: len(x) // UNIT * UNIT]


#: Rows are frequencies, columns samples: the transform's cosines times 2 ** 15, rounded.
_BASIS = np.array([[round((1 << 15) * (np.sqrt(0.5) if u == 0 else 1.0) / 2 * np.cos((2 * x + 1) * u * np.pi / 16)) for x in range(8)] for u in range(8)], float)
_DOWN = 2.0**-30
#: Blocks that are transformed at once.
BLOCKS = 1 << 13


def pad(data: bytes) -> np.ndarray:
    """data with bytes 255 up to a positive multiple of UNIT."""
    return np.frombuffer(data + b"\xff" * (-len(data) % UNIT if data else UNIT), np.uint8)


def encode_all(payload: np.ndarray) -> list[bytes]:
    return [encode(payload[a : a + TILE]) for a in range(0, len(payload), TILE)]


def media_columns(docs: DataFrame, text: str = "text", keep: list[str] | None = None, tensors: bool = True) -> DataFrame:
    """docs with each whole text stored as progressive JPEGs and read back.

    Adds n_bytes (of the text), payload_bytes and payload_sha256 (read back), tail_crc32 (of its last 32 bytes),
    media_bytes, media_sha256, feature (height and mean R, G, B in thousandths) and, with tensors, media (the JPEGs, in
    a row), height and rgb (height x 16 x 3 bytes). Null is empty, which is one unit of padding. Row by row, no shuffle:
    repeated rows and equal texts get equal values; ids play no part; an empty table gives an empty table. All columns of
    docs (or those in keep) are returned; one with the name of an added column is replaced.
    """
    added = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"} | ({"media": "binary", "height": "long", "rgb": "binary"} if tensors else {})

    def one(text: str | None) -> tuple:
        data = (text or "").encode()
        media = encode_all(pad(data))
        sha, stored, sums, height, size, tail, rgb = hashlib.sha256(), hashlib.sha256(), np.zeros(3, np.int64), 0, 0, b"", []
        for x in media:
            stored.update(x)
            p = Picture(x)
            back = p.payload()
            sha.update(back)
            size, tail = size + len(back), back[-32:].tobytes()
            picture = p.rgb()
            sums += picture.reshape(-1, 3).sum(0, dtype=np.int64)
            height += len(picture)
            if tensors:
                rgb.append(picture.tobytes())
        feature = ":".join(str(v) for v in (height, *(sums * 1000 // (16 * height)).tolist()))
        values = len(data), size, sha.hexdigest(), zlib.crc32(tail), sum(map(len, media)), stored.hexdigest(), feature
        return (*values, b"".join(media), height, b"".join(rgb)) if tensors else values

    def run(batches):
        for batch in batches:
            k = batch.num_columns - 1
            for a in range(0, batch.num_rows, 256):  # what a batch adds may be far larger than its texts
                part = batch.slice(a, 256)
                cols = list(zip(*(one(t.as_py()) for t in part.column(k)), strict=True))
                types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(k)), *(pa.array(c, types[t]) for c, t in zip(cols, added.values(), strict=True))], names=[*part.schema.names[:k], *added])

    kept = [c for c in (keep if keep is not None else docs.columns) if c not in added]
    src = docs.select(*kept, F.col(text).alias("__mc_text"))
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema if f.name != "__mc_text")
    return src.mapInArrow(run, types + ", ".join(f"{c} {t}" for c, t in added.items()))
