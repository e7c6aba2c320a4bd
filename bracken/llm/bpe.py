"""Byte-level BPE encoding by overlapping chunks, and decoding by concatenation.

A text is pre-tokenised in chunks of `CHUNK` characters, each read `OVERLAP` characters beyond its end. Two neighbours
are stitched at the first place in the overlap where both have a pre-token boundary: from there on the pattern's matches
are the same, as it never looks back. If an overlap has no such place (a run longer than it), the left chunk is read on
with a doubled overlap. Each distinct pre-token of a slice is then encoded once, through a bounded memory of earlier
ones; equal hashes are compared byte by byte. Decoding gathers the bytes of each id of the whole sequence. The pattern is public_tokenizers.PATTERN, in an array form that tests hold against the regex.

Defined results: null counts as empty, which has no ids; any string, whatever its length, is encoded whole; equal texts
give equal ids; extra columns are ignored; an empty table gives no rows. Decoding raises KeyError on an unknown id.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from . import _kit as kit

CHUNK, OVERLAP = 1 << 16, 1 << 9
#: Pre-tokens remembered at once by a worker.
REMEMBER = 400_000


@functools.cache
def _classes() -> np.ndarray:
    """Of every code point: 1 letter, 2 number, 3 white space (Unicode's White_Space), 0 any other."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    points = [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]
    whole = "".join(map(chr, points))
    at = np.array(points)
    for kind, shape in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(shape, whole):
            out[at[m.start() : m.end()]] = kind
    return out


def boundaries(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of PATTERN start, in code points of texts end to end; `first` has the texts' places.

    The array form of the pattern: runs of letters, numbers or other signs, each with one blank before it; a white-space
    run leaves its last character to what follows; 's 't 'm 'd 're 've 'll stand alone.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    c = _classes()[cp]
    row = np.zeros(n + 1, bool)
    row[first] = True
    row = row[:-1]
    run = row.copy()
    run[1:] |= c[1:] != c[:-1]
    blank_before = np.zeros(n, bool)
    blank_before[1:] = (cp[:-1] == 32) & ~row[1:]
    white = c == 3
    start = run & (white | ~blank_before)
    last = np.zeros(n, bool)  # white space with something else after it
    last[:-1] = white[:-1] & ~white[1:] & ~row[1:]
    start |= last
    quote = np.flatnonzero((cp == 39) & run & ~blank_before)
    quote = quote[quote + 1 < n]
    quote = quote[(c[quote + 1] == 1) & ~row[quote + 1]]
    if len(quote):
        one = cp[quote + 1]
        in_two = np.minimum(quote + 2, n - 1)
        two = np.where((quote + 2 < n) & (c[in_two] == 1) & ~row[in_two], cp[in_two], 0)
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for hit, size in ((quote[short], 2), (quote[long], 3)):
            start[hit + 1] = False
            then = hit + size
            then = then[then < n]
            start[then[(c[then] == 1) & ~row[then]]] = True
    return np.flatnonzero(start)


def stitched(cp: np.ndarray, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """The boundaries of one text, found chunk by chunk."""
    out, at, n = [], 0, len(cp)  # `at` is a boundary of the whole text
    one = np.zeros(1, np.int64)
    while at < n:
        more = overlap
        while True:
            end = min(n, at + chunk + more)
            left = boundaries(cp[at:end], one) + at
            if end == n:
                out.append(left)
                return np.concatenate(out)
            right = boundaries(cp[at + chunk : end], one) + at + chunk
            # What follows the last characters read may cut them differently: a contraction has three, a white-space
            # run any number.
            solid = np.flatnonzero(_classes()[cp[at + chunk : end]] != 3)
            safe = at + chunk + min(int(solid[-1]) if len(solid) else -1, end - at - chunk - 3)
            common = np.intersect1d(left[(left > at + chunk) & (left <= safe)], right)
            if len(common):
                break
            more *= 2
        out.append(left[left < common[0]])
        at = int(common[0])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def pretoken_starts(buf: np.ndarray, off: np.ndarray, chunk: int = CHUNK, overlap: int = OVERLAP):
    """Byte places where the rows' pre-tokens start, and each row's first among them. Long rows go by chunks."""
    cp, first = kit.points(buf, off)
    size = np.diff(first)
    if len(size) and size.max() > chunk + overlap:
        starts = []
        for i in np.flatnonzero(size):
            own = cp[first[i] : first[i + 1]]
            starts.append((stitched(own, chunk, overlap) if len(own) > chunk + overlap else boundaries(own, np.zeros(1, np.int64))) + first[i])
        start = np.concatenate(starts)
    else:
        start = boundaries(cp, first)
    bounds = np.searchsorted(start, first)
    lead = np.flatnonzero((buf & 0xC0) != 0x80) if len(cp) != len(buf) else None
    return (start if lead is None else lead[start]), bounds


class Ranks:
    """A vocabulary of byte strings with ranks; encodes as tiktoken does, without special tokens."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.known: dict[int, tuple] = {}

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    @functools.cached_property
    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens' bytes end to end, and each id's place and size (-1: no such id)."""
        size = np.full(max(self.bytes_of) + 1, -1, np.int64)
        for i, b in self.bytes_of.items():
            size[i] = len(b)
        first = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
        return np.frombuffer(b"".join([b for _, b in sorted(self.bytes_of.items())]), np.uint8), first, size

    def decode_rows(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The raw bytes of rows of ids laid end to end, and each row's first byte."""
        flat, place, size = self._table
        if len(ids) and (int(ids.max()) >= len(size) or (size[ids] < 0).any()):
            raise KeyError("unknown id")
        n = size[ids]
        total = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        return flat[np.repeat(place[ids] - total[:-1], n) + np.arange(total[-1])], total[first]

    def pieces(self, buf, off, make):
        """(values of the distinct pre-tokens, which of them each pre-token is, each row's first pre-token)."""
        start, bounds = pretoken_starts(buf, off)
        end = np.append(start[1:], len(buf))  # rows stand end to end, so a piece ends where the next starts
        at, which = kit.kinds(buf, start, end)
        raw, known = buf.tobytes(), self.known
        if len(known) > REMEMBER:
            known.clear()
        distinct = [raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]
        fresh = [piece for piece in distinct if piece not in known]
        known.update((piece, make(ids)) for piece, ids in zip(fresh, self.encode_pieces(fresh)))
        return [known[piece] for piece in distinct], which, bounds

    def encode_pieces(self, pieces: list[bytes]):
        """The ids of each pre-token."""
        return map(self.encoding._encode_single_piece, pieces)

    def encode_rows(self, buf, off) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and each row's first."""
        values, which, bounds = self.pieces(buf, off, lambda ids: array("I", ids).tobytes())
        size = np.array([len(v) // 4 for v in values], np.int64)
        flat = np.frombuffer(b"".join(values), np.uint32)
        base = (np.cumsum(size) - size)[which]
        n = size[which]
        total = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        return flat[np.repeat(base - total[:-1], n) + np.arange(total[-1])], total[bounds]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_rows(*kit.utf8(pa.array([text or ""])))[0].tolist()


def _default_path() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of every row."""
    own_path, own_pattern = path or _default_path()[0], _default_path()[1]

    def run(batches: Iterator[pa.RecordBatch]):
        ranks = Ranks(own_path, own_pattern)
        for part in kit.slices(batches):
            ids, first = ranks.encode_rows(*kit.utf8(part.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the raw bytes of ids; null ids count as none."""
    own_path, own_pattern = path or _default_path()[0], _default_path()[1]

    def run(batches):
        ranks = Ranks(own_path, own_pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([ranks.decode(x or ()) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def _decimals(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids as decimals joined by commas, row by row, as bytes end to end, and each row's first byte."""
    ids = ids.astype(np.int64)
    width = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 10))
    last = np.zeros(len(ids), bool)
    last[(first[1:] - 1)[np.diff(first) > 0]] = True
    size = width + ~last
    total = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(size, out=total[1:])
    out = np.full(int(total[-1]), ord(","), np.uint8)
    for k in range(10):
        at = np.flatnonzero(width > k)
        if not len(at):
            break
        out[total[at] + width[at] - 1 - k] = ord("0") + ids[at] // 10**k % 10
    return out, total[first]


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes and decodes every row at once; only digests leave the task."""
    own_path, own_pattern = path or _default_path()[0], _default_path()[1]

    def run(batches):
        ranks = Ranks(own_path, own_pattern)
        for part in kit.slices(batches):
            ids, first = ranks.encode_rows(*kit.utf8(part.column(1)))
            raw, at = ranks.decode_rows(ids, first)
            shown, place = _decimals(ids, first)
            digests = [[hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(x[:-1].tolist(), x[1:].tolist())] for data, x in ((shown, place), (raw, at))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first), pa.int64()), *[pa.array(x, pa.string()) for x in digests]], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    return round_trip_digests(kit.table(spark, sf_dir, "documents"))
