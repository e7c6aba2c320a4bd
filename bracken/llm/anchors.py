"""Exact search for repeated windows, dealt out by content.

A window is L consecutive tokens (bytes or words) of one document. Its anchor is the least hash among the K-grams in
it, so equal windows have equal anchors wherever they stand. Neighbouring windows with the same anchor form a segment.

1. Documents go into blocks by hash. Each block sends its distinct anchors, packed, to buckets by anchor.
2. A bucket answers each block with one bit per anchor: does another document have it?
3. Segments whose anchor is shared go, packed, to buckets by anchor, one copy of each content per block.
4. A bucket orders the distinct segments of an anchor by their first document and asks `matcher` which windows of a
   segment stand in segments of earlier documents; later owners of the same segment have all its windows marked.
5. Marked windows go back to their blocks as bit masks.

The text is shuffled once, by block, and that exchange is used three times. A hot passage costs each block one copy,
however many of its documents hold it. Nothing is sampled or capped, and nothing is collected.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _kit as kit

#: Windows in a segment at most, so that a mask fits 64 bits. Longer runs of one anchor are cut into more segments.
MOST = 64
#: Bytes of a block: BLOCK_BYTES in a small table, up to MOST_BLOCK_BYTES in a large one, so that there are about BLOCKS of
#: them before they grow in number. Messages go from each block to each bucket, so their count is the square of the blocks';
#: there are never more of them than anchors.
BLOCK_BYTES, MOST_BLOCK_BYTES, BLOCKS = 2 << 20, 8 << 20, 1024
_BLOCK = "__block"  # no column of a table


class Plan:
    """How a text becomes tokens: K-gram length k, window length l, tokens(buf, off) -> (hashes, bounds, start, end)."""

    def __init__(self, k: int, l: int, tokens: Callable, matcher: Callable, removed: Callable, schema: str):  # noqa: E741
        self.k, self.l, self.tokens, self.matcher, self.removed, self.schema = k, l, tokens, matcher, removed, schema


def _least(x: np.ndarray, width: int) -> np.ndarray:
    p = 1
    while p * 2 <= width:
        x = np.minimum(x[:-p], x[p:])
        p *= 2
    return np.minimum(x[: len(x) - (width - p)], x[width - p :]) if p < width else x


def _segments(plan: Plan, tokens: np.ndarray, bounds: np.ndarray, usable: np.ndarray):
    """Anchor, row, first window (token place) and number of windows of each segment."""
    n, l = len(tokens), plan.l
    valid = kit.inside(bounds, l, n)
    if not len(valid):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    anchor = _least(kit.grams(tokens, plan.k), l - plan.k + 1)
    new = np.ones(len(anchor) + 1, bool)
    new[1:-1] = anchor[1:] != anchor[:-1]
    new[bounds[bounds < len(new)]] = True
    first = np.flatnonzero(new[:-1] & valid)
    # A run ends where the next begins or where the windows leave their row.
    stop = np.flatnonzero(np.append(new[:-1] | ~valid, True))
    end = stop[np.searchsorted(stop, first, side="right")]
    row = np.searchsorted(bounds, first, side="right") - 1
    keep = usable[row]
    first, end, row = first[keep], end[keep], row[keep]
    pieces = -(-(end - first) // MOST)
    if len(pieces) and pieces.max() > 1:
        rep = np.repeat(np.arange(len(first)), pieces)
        nth = np.arange(len(rep)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, end, row = first[rep] + MOST * nth, np.minimum(end[rep], first[rep] + MOST * (nth + 1)), row[rep]
    return kit.mix(anchor[first]), row, first, end - first


def _block(plan: Plan, t: pa.Table):
    """The rows of a block in a fixed order, by doc_id and text, with tokens and segments."""
    t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids = t["doc_id"].combine_chunks()
    usable = ids.is_valid().to_numpy(zero_copy_only=False)
    docs = ids.fill_null(0).to_numpy(zero_copy_only=False)
    buf, off = kit.utf8(t["text"])
    return t, docs, usable, buf, off


def _parts(plan, usable, buf, off):
    """Segments of the block's rows, a bounded slice of rows at a time; token places count from the row's first."""
    at, rows = 0, len(off) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + kit.SLICE_BYTES, side="right")) - 1)
        b = buf[off[at] : off[end]]
        tokens, bounds, start, stop = plan.tokens(b, off[at : end + 1] - off[at])
        h, row, first, size = _segments(plan, tokens, bounds, usable[at:end])
        yield at, b, tokens, bounds, start, stop, h, row, first, size
        at = end


def _split(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each anchor, from its high bits."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _anchors(plan: Plan, buckets: int, t: pa.Table) -> pa.Table:
    block = t[_BLOCK][0].as_py()
    _, docs, usable, buf, off = _block(plan, t)
    hs, ds = [], []
    for at, _, _, _, _, _, h, row, _, _ in _parts(plan, usable, buf, off):
        hs.append(h)
        ds.append(docs[at + row])
    h, d = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (hs, ds))
    o = np.lexsort((d, h))
    h, d = h[o], d[o]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(h)) - 1
    h, several = h[at], d[at] != d[last] if len(at) else np.zeros(0, bool)
    b = _split(h, buckets)
    cut = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, int)
    end = np.append(cut[1:], len(b))
    low = h.astype(np.uint32)
    return pa.table({
        "bucket": pa.array(b[cut].astype(np.int64), pa.int64()),
        _BLOCK: pa.array(np.full(len(cut), block), pa.int64()),
        "low": pa.array([low[i:j].tobytes() for i, j in zip(cut, end)], pa.binary()),
        "several": pa.array([np.packbits(several[i:j]).tobytes() for i, j in zip(cut, end)], pa.binary()),
    })


def _shared(t: pa.Table) -> pa.Table:
    lows = [np.frombuffer(x, np.uint32) for x in t["low"].to_pylist()]
    size = np.array([len(x) for x in lows])
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(t["several"].to_pylist(), size)])
    low = np.concatenate(lows)
    o = np.argsort(low, kind="stable")
    s = low[o]
    same = s[1:] == s[:-1]
    hit = several[o].astype(bool)
    # Within a block an anchor may come twice by its low bits alone; that only lets a segment too many through.
    hit[1:] |= same
    hit[:-1] |= same
    # A block's mark "several" holds for the same anchor in other blocks as well: those are equal neighbours already.
    out = np.zeros(len(low), bool)
    out[o] = hit
    end = np.cumsum(size)
    return pa.table({
        _BLOCK: t[_BLOCK].combine_chunks(),
        "bucket": t["bucket"].combine_chunks(),
        "bits": pa.array([np.packbits(out[j - n : j]).tobytes() for j, n in zip(end, size)], pa.binary()),
        "size": pa.array(size, pa.int64()),
    })


def _apart(new: np.ndarray, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
    """Marks as new what follows other bytes of the same hash. An equal content that stands beyond it makes one more group,
    which the matcher finds like any other."""
    at = np.flatnonzero(~new)
    new[at] = ~kit.same_spans(text, start[at - 1], start[at], size[at])


def _sent(plan: Plan, buckets: int, targets: int, t: pa.Table, replies: pa.Table) -> pa.Table:
    schema = pa.schema([("target", pa.int64()), (_BLOCK, pa.int64())] + [(k, pa.binary()) for k in ("h", "size", "text_len", "text", "owners", "row", "start", "doc")])
    if not t.num_rows or not replies.num_rows:
        return schema.empty_table()
    block = t[_BLOCK][0].as_py()
    _, docs, usable, buf, off = _block(plan, t)
    replies = replies.sort_by("bucket")
    bits = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(replies["bits"].to_pylist(), replies["size"].to_pylist())]).astype(bool)
    got = list(_parts(plan, usable, buf, off))
    known = np.unique(np.concatenate([x[6] for x in got]))  # in the order in which they were sent
    shared = known[bits]
    cols: dict[str, list] = {k: [] for k in ("h", "c", "size", "row", "first", "doc", "from", "to")}
    base, texts = 0, []
    for at, b, tokens, bounds, start, stop, h, row, first, size in got:
        keep = np.isin(h, shared, kind="sort") if len(shared) else np.zeros(len(h), bool)
        h, row, first, size = h[keep], row[keep], first[keep], size[keep]
        up, down = kit.powers(len(tokens))
        total = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(tokens * up[: len(tokens)], out=total[1:])
        end = first + size + plan.l - 1
        cols["c"].append(kit.mix((total[end] - total[first]) * down[first]))
        cols["h"].append(h)
        cols["size"].append(size)
        cols["row"].append(row + at)
        cols["first"].append(first - bounds[row])
        cols["doc"].append(docs[row + at])
        cols["from"].append(start[first] + base)
        cols["to"].append(stop[end - 1] + base)
        base += len(b)
        texts.append(b)
    x = {k: np.concatenate(v) for k, v in cols.items()}
    whole = np.concatenate(texts)
    o = np.lexsort((x["first"], x["row"], x["doc"], x["size"], x["c"], x["h"]))
    x = {k: v[o] for k, v in x.items()}
    n = len(o)
    if not n:
        return schema.empty_table()
    new = np.ones(n, bool)
    long = x["to"] - x["from"]
    new[1:] = (x["h"][1:] != x["h"][:-1]) | (x["c"][1:] != x["c"][:-1]) | (x["size"][1:] != x["size"][:-1]) | (long[1:] != long[:-1])
    _apart(new, whole, x["from"], long)
    at = np.flatnonzero(new)
    owners = np.diff(np.append(at, n))
    target = _split(x["h"][at], targets)
    cut = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
    end = np.append(cut[1:], len(at))
    heads = {"h": x["h"][at].astype(np.uint32), "size": x["size"][at].astype(np.uint8), "text_len": (x["to"] - x["from"])[at].astype(np.int32), "owners": owners.astype(np.int32)}
    edge = np.append(at, n)
    rows = {"row": x["row"].astype(np.int32), "start": x["first"].astype(np.int32), "doc": x["doc"].astype(np.int64)}
    lo, hi = x["from"][at], x["to"][at]
    out: dict[str, list] = {k: [] for k in schema.names}
    for i, j in zip(cut, end):
        out["target"].append(int(target[i]))
        out[_BLOCK].append(block)
        for k, v in heads.items():
            out[k].append(v[i:j].tobytes())
        for k, v in rows.items():
            out[k].append(v[edge[i] : edge[j]].tobytes())
        out["text"].append(b"".join([whole[a:b].tobytes() for a, b in zip(lo[i:j], hi[i:j])]))
    return pa.table(out, schema)


def _matched(plan: Plan, t: pa.Table) -> pa.Table:
    # Anchors come by their low bits: two that meet in one group only make it larger.
    cat = lambda k, kind: np.frombuffer(b"".join(t[k].to_pylist()), kind)
    h, size, length, owners = cat("h", np.uint32), cat("size", np.uint8).astype(np.int64), cat("text_len", np.int32).astype(np.int64), cat("owners", np.int32).astype(np.int64)
    row, start, doc = cat("row", np.int32), cat("start", np.int32), cat("doc", np.int64)
    text = cat("text", np.uint8)
    end = np.cumsum(length)
    c = kit.span_hashes(text, end - length, end)
    first_owner = np.cumsum(owners) - owners
    o = np.lexsort((doc[first_owner], size, c, h))
    new = np.ones(len(o), bool)
    a, b = o[1:], o[:-1]
    new[1:] = (h[a] != h[b]) | (c[a] != c[b]) | (size[a] != size[b]) | (length[a] != length[b])
    _apart(new, text, (end - length)[o], length[o])
    group = np.cumsum(new) - 1
    rep = o[new]  # one of each content, from its first document
    of = np.empty(len(o), np.int64)
    of[o] = group
    mask = np.zeros(len(rep), np.uint64)
    least = doc[first_owner[rep]]
    # Only anchors with at least two contents can hold a window in segments that differ.
    q = np.lexsort((least, h[rep]))
    hr = h[rep][q]
    edge = np.flatnonzero(np.append(True, hr[1:] != hr[:-1]))
    count = np.diff(np.append(edge, len(hr)))
    if (count > 1).any():
        groups = [q[i : i + n] for i, n in zip(edge[count > 1], count[count > 1])]
        plan.matcher(groups, text, (end - length)[rep], end[rep], size[rep], least, mask)
    full = np.where(size == 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(size, 63).astype(np.uint64)) - np.uint64(1))
    seg = np.repeat(np.arange(len(h)), owners)
    marks = np.where(doc > least[of[seg]], full[seg], mask[of[seg]])
    block = np.repeat(np.repeat(t[_BLOCK].to_numpy(), [len(x) // 4 for x in t["h"].to_pylist()]), owners)
    keep = np.flatnonzero(marks)
    keep = keep[np.argsort(block[keep], kind="stable")]
    bl = block[keep]
    cut = np.flatnonzero(np.append(True, bl[1:] != bl[:-1])) if len(bl) else np.zeros(0, int)
    stop = np.append(cut[1:], len(bl))
    return pa.table({
        _BLOCK: pa.array(bl[cut].astype(np.int64), pa.int64()),
        **{k: pa.array([v[keep[i:j]].tobytes() for i, j in zip(cut, stop)], pa.binary()) for k, v in (("row", row), ("start", start), ("marks", marks))},
    })


def _finished(plan: Plan, t: pa.Table, marks: pa.Table) -> pa.Table:
    t2, docs, usable, buf, off = _block(plan, t)
    rows = len(off) - 1
    if not rows:
        return plan.removed(t2, buf, off, None, None, None)
    cat = lambda k, kind: np.frombuffer(b"".join(marks[k].to_pylist()), kind)
    row, start, mark = cat("row", np.int32), cat("start", np.int32), cat("marks", np.uint64)
    tokens_per_row, spans = plan.tokens(buf, off, count_only=True)
    bounds = np.zeros(rows + 1, np.int64)
    np.cumsum(tokens_per_row, out=bounds[1:])
    edge = np.zeros(int(bounds[-1]) + 1, np.int32)
    step = 1 << 16
    for i in range(0, len(mark), step):
        bit = np.unpackbits(np.ascontiguousarray(mark[i : i + step]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        seg, nth = np.nonzero(bit)
        place = bounds[row[i : i + step][seg]] + start[i : i + step][seg] + nth
        np.add.at(edge, place, 1)
        np.add.at(edge, place + plan.l, -1)
    return plan.removed(t2, buf, off, np.cumsum(edge[:-1]) > 0, bounds, spans)


def remove_repeats(docs: DataFrame, plan: Plan, block_bytes: int | None = None, carry: bool = False) -> DataFrame:
    """Runs the five steps over doc_id and text of all rows; returns plan.schema. carry: `plan.removed` sees all columns."""
    more = [F.col(f"`{c}`") for c in docs.columns if carry and c not in ("doc_id", "text")]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block_bytes = block_bytes or min(MOST_BLOCK_BYTES, max(BLOCK_BYTES, total // BLOCKS))
    blocks = max(48, math.ceil(total / block_bytes))
    buckets = targets = blocks
    dealt = docs.withColumn(_BLOCK, F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    by_block = lambda df: df.groupBy(_BLOCK)
    sent = by_block(dealt).applyInArrow(lambda t: _anchors(plan, buckets, t), "bucket long, __block long, low binary, several binary")
    replies = sent.groupBy("bucket").applyInArrow(_shared, "__block long, bucket long, bits binary, size long")
    segments = by_block(dealt).cogroup(by_block(replies)).applyInArrow(lambda a, b: _sent(plan, buckets, targets, a, b), "target long, __block long, h binary, size binary, text_len binary, text binary, owners binary, row binary, start binary, doc binary")
    marks = segments.groupBy("target").applyInArrow(lambda t: _matched(plan, t), "__block long, row binary, start binary, marks binary")
    return by_block(dealt).cogroup(by_block(marks)).applyInArrow(lambda a, b: _finished(plan, a, b), plan.schema)
