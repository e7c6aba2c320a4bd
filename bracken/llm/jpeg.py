"""Media columns as progressive JPEG.

A payload is kept in the quantised coefficients of a 4:2:0 progressive JPEG: each AC coefficient has magnitude 128 to 255,
whose upper seven bits go in the first scans of two spectral bands (Al=1) and whose lowest bit goes in a refinement scan
(Ah=1, Al=0); DC is 0. The payload's length stands in a comment segment.

The decoder accumulates any scans of spectral selection and successive approximation into coefficient arrays, then inverts
the transform with numpy, upsamples chroma and gives full-resolution RGB. Scans whose codes all have one length, as those
written here, are read as arrays; all others bit by bit.

Defined results: null counts as empty; a payload is never empty; equal payloads give equal files; extra columns are
ignored; an empty table gives no rows. Files that are not progressive JPEG raise ValueError.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _kit as kit

UNIT, FILL = 576, 255
BANDS = ((1, 5), (6, 63))
#: MCUs inverted at once.
STRIP = 2048
#: What ends a scan's data: neither a stuffed byte nor a restart marker.
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]")


@cache
def _zigzag() -> np.ndarray:
    """Place in the 8x8 block of each coefficient in file order."""
    return np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


@cache
def _inverse() -> np.ndarray:
    """Matrix from coefficients in file order to the samples of a block."""
    u = np.arange(8)
    c = np.cos((2 * u[None] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, math.sqrt(1 / 8), 0.5)[:, None]
    full = np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)
    return full[_zigzag()].astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@cache
def _one_code(kind: int, symbol: int, bits: int) -> bytes:
    """A Huffman table with one symbol, coded as `bits` zeros."""
    return _segment(0xC4, bytes([kind << 4]) + bytes(int(i + 1 == bits) for i in range(16)) + bytes([symbol]))


def _scan(components, ss, se, ah, al, data: bytes) -> bytes:
    return _segment(0xDA, bytes([len(components), *(x for c in components for x in (c, 0)), ss, se, ah << 4 | al])) + data


def encode(payload: bytes) -> bytes:
    """The payload as a progressive JPEG file."""
    n = len(payload)
    units = max(1, -(-n // (6 * 63)))
    w = math.isqrt(units - 1) + 1
    h = -(-units // w)
    full = np.full(w * h * 6 * 63, FILL, np.uint8)
    full[:n] = np.frombuffer(payload, np.uint8)
    blocks = full.reshape(-1, 63)
    y = 4 * w * h
    parts = (blocks[:y], blocks[y : y + w * h], blocks[y + w * h :])
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % n), _segment(0xDB, b"\0" + b"\1" * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    bits = 6 * w * h
    dc = b"\0" * (bits // 8) + (bytes([0xFF >> bits % 8]) if bits % 8 else b"")
    out += [_one_code(0, 0, 1), _scan((1, 2, 3), 0, 0, 0, 0, dc), _one_code(1, 7, 1)]
    for ss, se in BANDS:
        for i, p in enumerate(parts):
            out.append(_scan((i + 1,), ss, se, 0, 1, (p[:, ss - 1 : se] >> 1).tobytes()))
    for i, p in enumerate(parts):
        out += _refinement(i + 1, p)
    out.append(b"\xff\xd9")
    return b"".join(out)


def _refinement(component: int, blocks: np.ndarray):
    """A table and a scan: end-of-band runs, each followed by a bit for every coefficient of its blocks.

    All runs are of one size class r, so that the table has one code, of a length that fills whole bytes.
    """
    low = (blocks & 1).reshape(-1)
    count = len(blocks)
    r = min(14, count.bit_length() - 1)
    runs = max(1, count // ((1 << r + 1) - 1))
    while runs * ((1 << r + 1) - 1) < count:
        runs += 1
    size = 8 - r % 8
    bits, at = [], 0
    for k in range(runs):
        take = (count - at) // (runs - k)
        bits += [np.array([0] * size + [(take - (1 << r)) >> (r - 1 - i) & 1 for i in range(r)], np.uint8), low[at * 63 : (at + take) * 63]]
        at += take
    data = np.concatenate(bits)
    data = np.concatenate([data, np.ones(-len(data) % 8, np.uint8)])
    yield _one_code(1, r << 4, size)
    yield _scan((component,), 1, 63, 1, 0, np.packbits(data).tobytes().replace(b"\xff", b"\xff\0"))


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def bit(self) -> int:
        i = self.at
        self.at += 1
        return self.data[i >> 3] >> (7 - (i & 7)) & 1 if i >> 3 < len(self.data) else 1

    def take(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v

    def symbol(self, table: dict) -> int:
        code, n = 0, 0
        while n < 16:
            code, n = code << 1 | self.bit(), n + 1
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such Huffman code")


def _signed(v: int, size: int) -> int:
    return v if not size or v >> (size - 1) else v - (1 << size) + 1


class Image:
    """Coefficient arrays of a progressive JPEG: `coefficients[i]` is (rows, columns, 64) in file order."""

    def __init__(self, data: bytes):
        self.comment, self.tables, self.quant, self.restart = b"", {}, {}, 0
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        at = 2
        self.coefficients: list[np.ndarray] = []
        while at + 4 <= len(data):
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            if marker == 0xD9:
                break
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                self._quantisers(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xC2:
                self._frame(body)
            elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
                raise ValueError("not a progressive JPEG file")
            elif marker == 0xDA:
                found = _MARKER.search(data, at)
                end = found.start() if found else len(data)
                self._scan(body, data[at:end])
                at = end

    def _quantisers(self, b):
        at = 0
        while at < len(b):
            wide, which = b[at] >> 4, b[at] & 15
            n = 128 if wide else 64
            self.quant[which] = np.frombuffer(b[at + 1 : at + 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
            at += 1 + n

    def _huffman(self, b):
        at = 0
        while at < len(b):
            key, lengths = b[at], b[at + 1 : at + 17]
            n = sum(lengths)
            symbols = b[at + 17 : at + 17 + n]
            table, code, k = {}, 0, 0
            for size in range(1, 17):
                for _ in range(lengths[size - 1]):
                    table[size, code] = symbols[k]
                    code, k = code + 1, k + 1
                code <<= 1
            self.tables[key] = table
            at += 17 + n

    def _frame(self, b):
        _, self.height, self.width, n = struct.unpack_from(">BHHB", b)
        self.parts = [(b[6 + 3 * i], b[7 + 3 * i] >> 4, b[7 + 3 * i] & 15, b[8 + 3 * i]) for i in range(n)]
        self.hmax, self.vmax = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        self.mcu_w, self.mcu_h = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        self.coefficients = [np.zeros((self.mcu_h * v, self.mcu_w * h, 64), np.int16) for _, h, v, _ in self.parts]

    def _own(self, i):
        """The blocks of component i that a scan of its own covers."""
        _, h, v, _ = self.parts[i]
        return self.coefficients[i][: -(-self.height * v // (8 * self.vmax)), : -(-self.width * h // (8 * self.hmax))]

    def _scan(self, head, data):
        n = head[0]
        which = [(next(i for i, p in enumerate(self.parts) if p[0] == head[1 + 2 * k]), head[2 + 2 * k]) for k in range(n)]
        ss, se, ah, al = head[-3], head[-2], head[-1] >> 4, head[-1] & 15
        raw = data.replace(b"\xff\0", b"\xff") if b"\xff" in data else data
        if not self.restart and n == 1 and ss and self._fast(which[0], ss, se, ah, al, raw):
            return
        if not self.restart and ss == 0 and ah == 0 and all(self.tables[t >> 4] == {(1, 0): 0} for _, t in which):
            return  # every DC difference is 0
        self._slow(which, ss, se, ah, al, data)

    def _fast(self, component, ss, se, ah, al, raw) -> bool:
        i, tables = component
        table = self.tables[0x10 | tables & 15]
        if len(table) != 1:
            return False
        ((size, _), symbol), own = next(iter(table.items())), self._own(i)
        n = own.shape[0] * own.shape[1]
        width = se - ss + 1
        if ah == 0:
            bits = symbol & 15
            if symbol >> 4 or not bits or size + bits != 8 or len(raw) != n * width:
                return False
            v = np.frombuffer(raw, np.uint8).astype(np.int16)
            if (v >> bits).any():
                return False
            v = np.where(v >> (bits - 1) > 0, v, v - (1 << bits) + 1) * np.int16(1 << al)
            own[:, :, ss : se + 1] = v.reshape(own.shape[0], own.shape[1], width)
            return True
        if symbol & 15 or symbol >> 4 == 15:
            return False
        band = own[:, :, ss : se + 1]
        if not band.all():
            return False
        bits = np.unpackbits(np.frombuffer(raw, np.uint8))
        r, at, done, parts = symbol >> 4, 0, 0, []
        while done < n:
            at += size
            run = (1 << r) + (int("".join(map(str, bits[at : at + r])), 2) if r else 0)
            at += r
            run = min(run, n - done)
            parts.append(bits[at : at + run * width])
            at += run * width
            done += run
        bits = np.concatenate(parts).reshape(band.shape).astype(np.int16) << al
        own[:, :, ss : se + 1] = band + np.where(band > 0, bits, -bits)
        return True

    def _units(self, which):
        if len(which) == 1:
            own = self._own(which[0][0])
            for y in range(own.shape[0]):
                for x in range(own.shape[1]):
                    yield [(which[0], own[y, x])]
            return
        for my in range(self.mcu_h):
            for mx in range(self.mcu_w):
                yield [((i, t), self.coefficients[i][my * self.parts[i][2] + v, mx * self.parts[i][1] + h]) for i, t in which for v in range(self.parts[i][2]) for h in range(self.parts[i][1])]

    def _slow(self, which, ss, se, ah, al, data):
        pieces, start, i = [], 0, 0
        while i + 1 < len(data):  # restart markers cut the data
            if data[i] == 0xFF and 0xD0 <= data[i + 1] <= 0xD7:
                pieces.append(data[start:i])
                start = i + 2
            i += 2 if data[i] == 0xFF else 1
        pieces = [_Bits(p.replace(b"\xff\0", b"\xff")) for p in [*pieces, data[start:]]]
        bits, dc, run = pieces[0], {}, 0
        for k, unit in enumerate(self._units(which)):
            if self.restart and k and k % self.restart == 0:
                bits, dc, run = pieces[k // self.restart], {}, 0
            for (i, t), block in unit:
                if ss == 0:
                    if ah:
                        block[0] |= bits.bit() << al
                    else:
                        size = bits.symbol(self.tables[t >> 4])
                        dc[i] = dc.get(i, 0) + _signed(bits.take(size), size)
                        block[0] = dc[i] << al
                elif ah == 0:
                    run = self._first(bits, self.tables[0x10 | t & 15], block, ss, se, al, run)
                else:
                    run = self._refine(bits, self.tables[0x10 | t & 15], block, ss, se, al, run)

    @staticmethod
    def _first(bits, table, block, ss, se, al, run):
        if run:
            return run - 1
        k = ss
        while k <= se:
            symbol = bits.symbol(table)
            r, size = symbol >> 4, symbol & 15
            if size:
                k += r
                block[k] = _signed(bits.take(size), size) * (1 << al)
                k += 1
            elif r == 15:
                k += 16
            else:
                return (1 << r) + bits.take(r) - 1
        return 0

    @staticmethod
    def _refine(bits, table, block, ss, se, al, run):
        def correct(k):
            if bits.bit():
                block[k] += (1 << al) if block[k] > 0 else -(1 << al)

        k = ss
        if not run:
            while k <= se:
                symbol = bits.symbol(table)
                r, size = symbol >> 4, symbol & 15
                new = 0
                if size:
                    new = (1 << al) if bits.bit() else -(1 << al)
                elif r < 15:
                    run = (1 << r) + bits.take(r)
                    break
                while k <= se:
                    if block[k]:
                        correct(k)
                    elif r:
                        r -= 1
                    else:
                        if new:
                            block[k] = new
                        k += 1
                        break
                    k += 1
        if run:
            while k <= se:
                if block[k]:
                    correct(k)
                k += 1
            return run - 1
        return 0

    def strips(self):
        """RGB samples, uint8 (rows, width, 3), a few MCU rows at a time."""
        step = max(1, STRIP // self.mcu_w)
        for top in range(0, self.mcu_h, step):
            planes = []
            for (_, h, v, q), c in zip(self.parts, self.coefficients):
                own = c[top * v : (top + step) * v]
                rows, cols = own.shape[:2]
                x = (own.reshape(-1, 64).astype(np.float32) * self.quant[q]) @ _inverse()
                x = x.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
                if v < self.vmax or h < self.hmax:
                    x = x.repeat(self.vmax // v, 0).repeat(self.hmax // h, 1)
                planes.append(x)
            y = planes[0] + np.float32(128)
            if len(planes) == 3:
                cb, cr = planes[1], planes[2]
                rgb = np.stack([y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb], 2)
            else:
                rgb = np.repeat(y[:, :, None], 3, 2)
            lo = top * 8 * self.vmax
            yield np.clip(np.rint(rgb), 0, 255).astype(np.uint8)[: self.height - lo, : self.width]

    def rgb(self) -> np.ndarray:
        return np.concatenate(list(self.strips()))


def payload(image: Image) -> bytes:
    """The bytes that `encode` stored, from the coefficients."""
    v = np.concatenate([c.reshape(-1, 64)[:, 1:].reshape(-1) for c in image.coefficients]).astype(np.int16)
    size = np.abs(v)
    high = np.where(v > 0, size >> 1, 127 - (size >> 1))
    return (high << 1 | size & 1).astype(np.uint8)[: int(image.comment.split()[1])].tobytes()


def padded(b: bytes) -> bytes:
    return b + bytes([FILL]) * (-len(b) % UNIT if b else UNIT)


def feature(image: Image) -> str:
    """Size, then the mean of each channel."""
    total, n = np.zeros(3, np.int64), 0
    for strip in image.strips():
        total += strip.sum((0, 1), dtype=np.int64)
        n += strip.shape[0] * strip.shape[1]
    return f"{image.width}x{image.height} " + " ".join(str(int(x) // n) for x in total)


def tensors(docs: DataFrame) -> DataFrame:
    """doc_id, file, and the decoded RGB tensor with its height and width."""

    def run(batches):
        for part in kit.slices(batches, most=1 << 18):
            files = [encode(padded((t or "").encode())) for t in part.column(1).to_pylist()]
            images = [Image(f) for f in files]
            cols = [part.column(0), pa.array(files, pa.binary()), pa.array([i.height for i in images], pa.int32()), pa.array([i.width for i in images], pa.int32()), pa.array([i.rgb().tobytes() for i in images], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "jpeg", "height", "width", "rgb"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, jpeg binary, height int, width int, rgb binary")


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(docs: DataFrame) -> DataFrame:
    """Stores, reads back and describes every row's payload."""

    def run(batches):
        for part in kit.slices(batches):
            out = []
            for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                raw = (t or "").encode()
                file = encode(padded(raw))
                image = Image(file)
                back = payload(image)
                out.append((d, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature(image)))
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def media_round_trip(spark, sf_dir: str) -> DataFrame:
    return digests(kit.table(spark, sf_dir, "documents"))
