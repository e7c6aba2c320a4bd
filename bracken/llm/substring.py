"""Substring dedup over words, by suffix automata of reference shards.

A reference shard is the set of distinct segments (see `anchors`) that share an anchor, in order of their first
document. A shard's suffix automaton holds the segments of earlier documents; each later segment streams through it for
its matching statistics, the length of the longest match ending at each word, before it is added itself. Matches of at
least `window` words are marked. Every equal window meets in one shard, so no shard has to visit every document:
sending each automaton to all tasks would cost documents times shards.

Defined results: null or empty text has no words; a null doc_id neither marks nor is marked; rows with the same doc_id
do not mark each other; equal rows get equal results; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _kit as kit, anchors

WINDOW = 50


class Automaton:
    """A suffix automaton of several word sequences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]

    def add(self, words) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._clone(last, w, q)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            last = cur

    def _clone(self, p: int, w, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(nxt[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def statistics(self, words) -> list[int]:
        """Length of the longest match that ends at each word."""
        nxt, link, length = self.next, self.link, self.length
        state, size, out = 0, 0, []
        for w in words:
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nxt[state].get(w)
            if to is not None:
                state, size = to, size + 1
            out.append(size)
        return out


def _tokens(buf, off, count_only=False):
    w = kit.Words(buf, off)
    if count_only:
        return w.per_row, w
    return w.hash, w.bounds, w.start, w.end


def _match(groups, text, lo, hi, size, least, mask, window=WINDOW):
    for group in groups:
        shard, waiting, at = Automaton(), [], None
        for g in group:  # ordered by first document
            words = text[lo[g] : hi[g]].tobytes().split()
            if least[g] != at:  # segments of one document do not mark each other
                for x in waiting:
                    shard.add(x)
                waiting, at = [], least[g]
            if len(shard.next) > 1:
                m = 0
                for end, n in enumerate(shard.statistics(words)):
                    if n >= window:
                        m |= 1 << (end - window + 1)
                mask[g] |= np.uint64(m)
            waiting.append(words)


def _kept(b: bytes, covered) -> bytes:
    words = b.split()
    return b" ".join(compress(words, ~covered) if covered is not None else words)


def _digests(t, buf, off, covered, bounds, words):
    n, removed, sha = [], [], []
    raw = buf.tobytes()
    for i in range(len(off) - 1):
        c = covered[bounds[i] : bounds[i + 1]]
        gone = int(np.count_nonzero(c))
        n.append(len(c))
        removed.append(gone)
        sha.append(hashlib.sha256(_kept(raw[off[i] : off[i + 1]], c if gone else None)).hexdigest())
    return pa.table({"doc_id": t["doc_id"], "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def _texts(names, t, buf, off, covered, bounds, words):
    """The rows' columns, with the kept words joined by one space (the text as it was if nothing goes) and its length."""
    raw, text = buf.tobytes(), []
    for i in range(len(off) - 1):
        c = covered[bounds[i] : bounds[i + 1]]
        b = raw[off[i] : off[i + 1]]
        text.append((_kept(b, c) if c.any() else b).decode("utf-8"))
    new = {"text": pa.array(text, pa.string()), "n_chars": pa.array([len(x) for x in text], pa.int64())}
    return pa.table({c: new.get(c, t[c] if c in t.column_names else None) for c in names})


def _plan(removed, schema):
    return anchors.Plan(16, WINDOW, _tokens, _match, removed, schema)


def dedup_texts(docs: DataFrame) -> DataFrame:
    """The rows without the words in windows that stand in a document with a smaller doc_id; n_chars, if any, follows.

    A text of which nothing is left stays as an empty one.
    """
    names = docs.columns
    kinds = {f.name: "long" if f.name in ("doc_id", "n_chars") else f.dataType.simpleString() for f in docs.schema}
    plan = _plan(partial(_texts, names), ", ".join(f"`{c}` {kinds[c]}" for c in names))
    return anchors.remove_repeats(docs, plan, carry=True).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in docs.schema])


def substring_dedup(spark, sf_dir: str) -> DataFrame:
    return anchors.remove_repeats(kit.table(spark, sf_dir, "documents"), _plan(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string"))
