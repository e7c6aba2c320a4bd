"""Repeated byte strings, by a run-length index of repetitive text.

`RunIndex` is a run-compressed Burrows-Wheeler transform: the runs' characters and first rows, the backward step of
each run's first row, and the text places of both ends of each run. `statistics` streams strings backwards through it,
all in step: while the row's run has the next character the match grows by one; if not, it goes on from the nearer
sampled end of the run before or after that has it, whichever shares more with the match so far.

Documents are dealt out as segments (see `anchors`), and an index holds the distinct segments of many anchors, but for
those of each anchor's last document; those of all but its first are streamed. A match of at least `WINDOW` bytes is
marked if the first document that has those bytes, kept for each place of the index, is earlier than the segment's own.

Defined results: texts are UTF-8; null counts as empty; a null doc_id neither marks nor is marked; rows with the same
doc_id do not mark each other; equal rows get equal results; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _kit as kit, anchors

WINDOW = 50
#: Bytes of one index at most, except that a segment is never cut; larger sets take more indexes.
INDEX_BYTES = 1 << 20
_P = 21  # bits of a place


class RunIndex:
    """Over strings end to end, each ended by 0; other symbols are 1 to 255."""

    def __init__(self, text: np.ndarray, longest: int):
        n = len(text)
        self.n = n
        wide = np.zeros(n + 8, np.uint64)
        wide[:n] = text
        key = np.zeros(n, np.uint64)
        open_ = np.ones(n, bool)  # a suffix ends with its string
        for j in range(8):
            c = wide[j : j + n]
            key = (key << np.uint64(8)) | np.where(open_, c, np.uint64(0))
            open_ &= c != 0
        self.eight = key
        end = np.flatnonzero(text == 0)
        self.left = left = end[np.searchsorted(end, np.arange(n))] - np.arange(n)  # symbols before the end
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, s[1:] != s[:-1]))
        self.ranks, depth = [(8, rank)], 8
        place = np.arange(n)
        while depth <= max(longest, 32):
            then = np.zeros(n, np.int64)
            far = left >= depth
            then[far] = rank[place[far] + depth] + 1
            k = (((rank << (_P + 1)) | then).astype(np.uint64) << np.uint64(_P)) | place.astype(np.uint64)
            k.sort()
            order = (k & np.uint64((1 << _P) - 1)).astype(np.int64)
            k >>= np.uint64(_P)
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(0, k[1:] != k[:-1]))
            depth *= 2
            self.ranks.append((depth, rank))
        sa = order  # equal strings stay in order of place
        bwt = text[sa - 1]  # row of place 0 has the last end, which is 0 as well
        head = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1]))
        length = np.diff(np.append(head, n))
        symbol = bwt[head].astype(np.int64)
        by = np.argsort(symbol, kind="stable")
        step = np.empty(len(head), np.int64)
        step[by] = np.cumsum(length[by]) - length[by]
        self.head, self.symbol, self.step = head, symbol, step
        self.first, self.last = sa[head], sa[head + length - 1]  # the sampled ends
        self.tail = head + length - 1
        self.by, self.sorted = by, symbol[by] * (len(head) + 1) + by
        mark = np.zeros((n >> 6) * 64 + 64, np.uint8)
        mark[head] = 1
        self.bits = np.packbits(mark, bitorder="little").view(np.uint64)
        self.before = np.cumsum(np.bitwise_count(self.bits)).astype(np.int64) - np.bitwise_count(self.bits)

    def first_owner(self, window: int, owner: np.ndarray) -> np.ndarray:
        """For each place, the least owner of a place with the same `window` (33 to 64) symbols."""
        depth, rank = self.ranks[2]
        whole = np.flatnonzero(self.left >= window)
        key = (rank[whole].astype(np.uint64) << np.uint64(32)) | rank[whole + window - depth].astype(np.uint64)
        order = np.argsort(key, kind="stable")
        s = key[order]
        cut = np.flatnonzero(np.append(True, s[1:] != s[:-1])[: len(s)])
        out = np.full(self.n, np.iinfo(np.int64).max)
        if len(cut):
            out[whole[order]] = np.repeat(np.minimum.reduceat(owner[whole[order]], cut), np.diff(np.append(cut, len(s))))
        return out

    def run(self, row: np.ndarray) -> np.ndarray:
        word, bit = row >> 6, (row & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.bits[word] << (np.uint64(63) - bit)) - 1

    def shared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at two places have in common, `most` at most (no more than the first has)."""
        a, b, got = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for depth, rank in reversed(self.ranks):
            same = np.flatnonzero((rank[a] == rank[b]) & (got + depth <= most))
            for x in (a, b, got):
                x[same] += depth
            np.minimum(a, self.n - 1, out=a)
            np.minimum(b, self.n - 1, out=b)
        x = self.eight[a] ^ self.eight[b]
        high = x >> np.uint64(32)
        used = np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], np.frexp((x & np.uint64(2**32 - 1)).astype(np.float64))[1])
        return np.minimum(got + np.where(x == 0, 8, (64 - used) // 8), most)

    def statistics(self, text: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """Streams text[lo:hi] of each query backwards; gives, at each step, the queries, their
        places, the longest match from there, and a place in the index where it stands."""
        q = len(lo)
        row, size, at = np.zeros(q, np.int64), np.zeros(q, np.int64), np.zeros(q, np.int64)
        at[:] = self.first[0]
        runs = len(self.head)
        place = hi - 1
        live = np.arange(q)
        while len(live):
            c = text[place[live]].astype(np.int64)
            k = self.run(row[live])
            ok = self.symbol[k] == c
            no = np.flatnonzero(~ok)
            if len(no):
                w, cn, kn = live[no], c[no], k[no]
                i = np.searchsorted(self.sorted, cn * (runs + 1) + kn)
                up, down = np.minimum(i, runs - 1), np.maximum(i - 1, 0)
                up, down = self.by[up], self.by[down]
                has_up, has_down = self.symbol[up] == cn, self.symbol[down] == cn
                s_up = np.where(has_up, self.shared(at[w], self.first[up], size[w]), -1)
                s_down = np.where(has_down, self.shared(at[w], self.last[down], size[w]), -1)
                take = s_up >= s_down
                to = np.where(take, up, down)
                size[w] = np.maximum(0, np.where(take, s_up, s_down))
                row[w] = np.where(take, self.head[up], self.tail[down])
                at[w] = np.where(take, self.first[up], self.last[down])
                k[no] = to
                ok[no] = has_up | has_down
            good = live[ok]
            kg = k[ok]
            row[good] = self.step[kg] + row[good] - self.head[kg]
            at[good] -= 1
            size[good] += 1
            bad = live[~ok]  # the symbol is nowhere in the index
            size[bad] = 0
            yield live, place[live], size[live], at[live]
            place[live] -= 1
            live = live[place[live] >= lo[live]]


def _match(groups, text, lo, hi, size, least, mask, window=WINDOW):
    """Indexes the segments of all but each anchor's last document; streams those of all but its first."""
    symbols = text + np.uint8(1)  # UTF-8 never has 255
    length = hi - lo
    index, queries, held = [], [], 0
    for g in groups:  # ordered by first document
        index.append(g[least[g] < least[g[-1]]])
        queries.append(g[least[g] > least[g[0]]])
        held += int((length[index[-1]] + 1).sum())
        if held >= INDEX_BYTES:
            _stream(np.concatenate(index), np.concatenate(queries), symbols, lo, hi, length, least, mask, window)
            index, queries, held = [], [], 0
    if held:
        _stream(np.concatenate(index), np.concatenate(queries), symbols, lo, hi, length, least, mask, window)


def _stream(index, queries, symbols, lo, hi, length, least, mask, window):
    for part in np.split(index, np.flatnonzero(np.diff(np.cumsum(length[index] + 1) // INDEX_BYTES)) + 1):
        size = length[part] + 1
        end = np.cumsum(size)
        source = np.repeat(lo[part] - (end - size), size) + np.arange(end[-1])
        joined = symbols[np.minimum(source, len(symbols) - 1)]
        joined[end - 1] = 0
        run_index = RunIndex(joined, int(length[part].max()))
        first = run_index.first_owner(window, np.repeat(least[part], size))
        for live, place, match, at in run_index.statistics(symbols, lo[queries], hi[queries]):
            long = np.flatnonzero(match >= window)
            g = queries[live[long]]
            earlier = first[at[long]] < least[g]
            g, p = g[earlier], place[long[earlier]]
            mask[g] |= np.uint64(1) << (p - lo[g]).astype(np.uint64)


def _tokens(buf, off, count_only=False):
    if count_only:
        return np.diff(off), None
    at = np.arange(len(buf))
    return kit.BYTE_KEYS[buf], off, at, at + 1


def _digests(t, buf, off, covered, bounds, _):
    n = np.diff(off)
    removed = np.zeros(len(n), np.int64)
    spans = np.zeros(len(n), np.int64)
    sha = []
    if covered is not None:
        removed = kit.counts(covered, off)
        fresh = covered & ~np.append(False, covered[:-1])
        starts = np.zeros(len(buf) + 1, bool)
        starts[off] = True
        fresh |= covered & starts[:-1]
        spans = kit.counts(fresh, off)
    for i in range(len(n)):
        b = buf[off[i] : off[i + 1]]
        sha.append(hashlib.sha256(b[~covered[off[i] : off[i + 1]]].tobytes() if removed[i] else b.tobytes()).hexdigest())
    return pa.table({"doc_id": t["doc_id"], "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def _spans(t, buf, off, covered, bounds, _):
    """doc_id, the bytes that stay, and the removed runs as [start, end) byte places."""
    kept, runs = [], []
    for i in range(len(off) - 1):
        b = buf[off[i] : off[i + 1]]
        c = covered[off[i] : off[i + 1]].astype(np.int8)
        kept.append(b[c == 0].tobytes())
        edge = np.flatnonzero(np.diff(np.concatenate([[0], c, [0]])))
        runs.append(edge.tolist())
    return pa.table({"doc_id": t["doc_id"], "kept": pa.array(kept, pa.binary()), "removed": pa.array(runs, pa.list_(pa.int64()))})


def _plan(removed, schema):
    return anchors.Plan(24, WINDOW, _tokens, _match, removed, schema)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, kept bytes, and removed (start, end, start, end, ...)."""
    return anchors.remove_repeats(docs, _plan(_spans, "doc_id long, kept binary, removed array<long>"))


def suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return anchors.remove_repeats(kit.table(spark, sf_dir, "documents"), _plan(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
