"""Shared array tools: Arrow batches to byte buffers, words, hashes, n-grams.

Everything works on whole texts, one bounded slice of a batch at a time.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once by the array code; bounds a worker's memory, never a text.
SLICE_BYTES = 1 << 20

U = np.uint64
_MIX1, _MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
BYTE_KEYS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | U(1)

#: Longer spans are hashed and compared one by one.
LONG_SPAN = 256

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= n."""
    if len(_powers[0]) <= n:
        size = 1 << int(n).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            x = np.full(size + 1, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; spreads every input bit."""
    x = (x ^ (x >> U(30))) * _MIX1
    x = (x ^ (x >> U(27))) * _MIX2
    return x ^ (x >> U(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


@cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def release() -> None:
    """Gives freed memory back to the system: idle workers are kept for later tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of about `most` bytes of text; a longer text makes a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = utf8(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end
        release()


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of texts: start, end (byte places), doc (row), hash."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        n = len(buf)
        self.buf, self.off = buf, off
        solid = ~_SPACE[buf]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.zeros(n, bool)
        before[1:] = solid[:-1]
        self.start = np.flatnonzero(solid & (~before | edge[:-1]))
        after = np.zeros(n, bool)
        after[:-1] = solid[1:]
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.doc = np.searchsorted(off, self.start, side="right") - 1
        self.bounds = np.searchsorted(self.start, off)  # first word of each row
        self._hash = self._ids = None

    @property
    def ids(self) -> np.ndarray:
        """A number for each word: equal words, and no others, have equal numbers."""
        if self._ids is None:
            self._ids = kinds(self.buf, self.start, self.end, self.hash)[1]
        return self._ids

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hashes(self.buf, self.start, self.end)
        return self._hash

    @property
    def per_row(self) -> np.ndarray:
        return np.diff(self.bounds)


def _wide(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number (zeros follow the last)."""
    held = np.zeros(len(buf) + 8, np.uint8)
    held[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", held, 0, (1,))


def _eights(wide: np.ndarray, start: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """The k-th eight bytes of spans of more than 8 * k bytes."""
    got = wide[start + 8 * k]
    left = size - 8 * k
    short = np.flatnonzero(left < 8)
    got[short] &= (U(1) << (U(8) * left[short].astype(np.uint64))) - U(1)
    return got


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes in each span, the same wherever they stand. `same_spans` tells equal ones for sure."""
    size = end - start
    h = mix(size.astype(np.uint64) + U(_BASE))
    wide, k = _wide(buf), 0
    rows = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    while len(rows):
        h[rows] = mix((h[rows] ^ _eights(wide, start[rows], size[rows], k)) * U(_BASE))
        k += 1
        rows = rows[size[rows] > 8 * k]
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]], digest_size=8).digest(), "little")
    return h


def same_spans(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes from each place a on equal those from b on, byte by byte."""
    same = np.ones(len(a), bool)
    wide, k = _wide(buf), 0
    rows = np.flatnonzero((size > 0) & (size <= LONG_SPAN) & (a != b))
    while len(rows):
        same[rows] = _eights(wide, a[rows], size[rows], k) == _eights(wide, b[rows], size[rows], k)
        k += 1
        rows = rows[same[rows] & (size[rows] > 8 * k)]
    for i in np.flatnonzero((size > LONG_SPAN) & (a != b)).tolist():
        same[i] = np.array_equal(buf[a[i] : a[i] + size[i]], buf[b[i] : b[i] + size[i]])
    return same


def kinds(buf: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(one span of each content, which of them each span is): equal hashes are compared byte by byte."""
    h = span_hashes(buf, start, end) if h is None else h
    _, at, which = np.unique(h, return_index=True, return_inverse=True)
    rep, size = at[which] if len(at) else which, end - start
    other = np.flatnonzero(rep != np.arange(len(h)))
    like = (size[rep[other]] == size[other]) & same_spans(buf, start[rep[other]], start[other], size[other])
    if like.all():
        return at, which
    names: dict[bytes, int] = {}  # unlike bytes of one hash: by their bytes
    raw = buf.tobytes()
    which = np.array([names.setdefault(raw[x:y], len(names)) for x, y in zip(start.tolist(), end.tolist())], np.int64)
    return np.unique(which, return_index=True)[1], which


def grams(x: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive values (fewer than n values: none), by doubling."""
    if len(x) < n:
        return np.zeros(0, np.uint64)
    out, width, place = None, 1, 0
    part, base = x, _BASE  # part: hashes of `width` values from each place on
    while True:
        if n & width:
            if out is None:
                out = part
            else:
                out = out[: len(x) - place - width + 1] * U(base) + part[place : place + len(x) - place - width + 1]
            place += width
        if place == n:
            return mix(out[: len(x) - n + 1])
        part = part[: len(part) - width] * U(base) + part[width:]
        width, base = width * 2, base * base % 2**64


def inside(bounds: np.ndarray, n: int, total: int) -> np.ndarray:
    """Whether the n values from each place on all belong to one row, given the rows' first places."""
    if total < n:
        return np.zeros(0, bool)
    ok = np.zeros(total + 1, np.int32)
    first, last = bounds[:-1], bounds[1:]
    has = last - first >= n
    np.add.at(ok, first[has], 1)
    np.add.at(ok, last[has] - n + 1, -1)
    return np.cumsum(ok[:-1])[: total - n + 1] > 0


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values of each row, given the rows' first places."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def counts(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def points(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts end to end, and the rows' first places among them."""
    lead = (buf & 0xC0) != 0x80
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(lead, out=total[1:])
    return np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), total[off]


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
