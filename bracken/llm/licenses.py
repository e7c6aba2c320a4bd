"""License scans by ordered signature rules.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. The base phrases are found as runs of words. The
rules are the hand-written signatures of `signatures`. Detections are ordered by priority, then length; one that lies inside
the interval of an earlier one is suppressed, and what remains gives labels and score.

Defined results: null counts as empty; no words give empty labels, score 0 and null places; equal texts give equal results;
extra columns are ignored; an empty table gives no rows. Labels of base phrases always stay.
"""

from __future__ import annotations

import re
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _kit as kit
from .signatures import TABLE

#: Fixed values of the contract.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


class Rule(NamedTuple):
    label: str
    pattern: re.Pattern
    keywords: tuple[str, ...]
    priority: int
    confidence: float


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order: by priority, then as listed."""
    out = []
    for line in TABLE.strip().splitlines():
        label, priority, confidence, keywords, shape = line.split(" | ", 4)
        out.append(Rule(label, re.compile(rf"(?<!\S)(?:{shape})(?!\S)"), tuple(keywords.split()), int(priority), float(confidence)))
    return tuple(sorted(out, key=lambda r: -r.priority))


@cache
def _prepared():
    words = sorted({k for r in rules() for k in r.keywords if k[-1] != "*"})
    buf, off = kit.utf8(pa.array([" ".join(words)]))
    h = kit.Words(buf, off).hash
    base = []
    for phrase, label in BASE.items():
        b, o = kit.utf8(pa.array([phrase]))
        base.append((kit.Words(b, o).hash, label))
    by = {}
    for k, x in zip(words, h.tolist()):
        by[x] = k
    return np.sort(h), by, base


@cache
def _prefixes() -> list[str]:
    return sorted({k for r in rules() for k in r.keywords if k[-1] == "*"})


def held_keywords(w: kit.Words) -> dict[int, set[str]]:
    """The keywords that each row holds, of rows that hold any; `w`: lower-case words."""
    held: dict[int, set] = {}
    n = len(w.start)
    if not n:
        return held
    keys, name_of, _ = _prepared()
    i = np.minimum(np.searchsorted(keys, w.hash), len(keys) - 1)
    gate = np.flatnonzero(keys[i] == w.hash)
    for r, k in set(zip(w.doc[gate].tolist(), w.hash[gate].tolist())):
        held.setdefault(r, set()).add(name_of[k])
    size = w.end - w.start
    for k in _prefixes():
        at = np.flatnonzero(size >= len(k) - 1)
        for j, c in enumerate(k[:-1].encode()):
            at = at[w.buf[w.start[at] + j] == c]
        for r in np.unique(w.doc[at]).tolist():
            held.setdefault(r, set()).add(k)
    return held


_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BLANK = np.where(_WORD, _LOWER, 0x20).astype(np.uint8)


def detect(words: str, held: set[str]) -> tuple[set[str], float, list[tuple[int, int, str]]]:
    """Labels, score and kept detections (start, end, label) of words joined by blanks that hold the keywords `held`."""
    found = []
    for r in rules():
        if held.issuperset(r.keywords):
            found += [(-r.priority, m.start() - m.end(), m.start(), m.end(), r) for m in r.pattern.finditer(words) if m.end() > m.start()]
    found.sort(key=lambda x: x[:4])
    kept: list[tuple[int, int, str]] = []
    score = 0.0
    starts: list[tuple[int, int]] = []
    for _, _, a, b, r in found:
        if not _inside(starts, a, b):
            _insert(starts, a, b)
            kept.append((a, b, r.label))
            score = max(score, r.confidence)
    return {x[2] for x in kept}, score, kept


def _inside(kept: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether an interval lies in a kept one; `kept` has no interval inside another, so ends are sorted like starts."""
    import bisect

    i = bisect.bisect_right(kept, (a, float("inf"))) - 1
    return i >= 0 and kept[i][1] >= b


def _insert(kept, a, b):
    import bisect

    i = bisect.bisect_left(kept, (a, b))
    while i < len(kept) and kept[i][1] <= b:  # shorter ones inside the new one: no longer needed for the test
        del kept[i]
    kept.insert(i, (a, b))


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame) -> DataFrame:
    """Base places, labels and score of every row."""

    def run(batches):
        _, _, base = _prepared()
        for part in kit.slices(batches):
            buf, off = kit.utf8(part.column(1))
            plain = _BLANK[buf]
            w = kit.Words(plain, off)
            rows, n = len(off) - 1, len(w.start)
            first, last = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
            total = np.zeros(rows, np.int64)
            base_labels: list[set] = [set() for _ in range(rows)]
            at_word = np.arange(n) - w.bounds[w.doc] if n else np.zeros(0, np.int64)
            for hashes, label in base:
                k = len(hashes)
                hit = np.flatnonzero(w.hash[: max(0, n - k + 1)] == hashes[0])
                for j in range(1, k):
                    hit = hit[w.hash[hit + j] == hashes[j]]
                hit = hit[w.doc[hit] == w.doc[np.minimum(hit + k - 1, n - 1)]] if n else hit
                np.add.at(total, w.doc[hit], 1)
                np.minimum.at(first, w.doc[hit], at_word[hit])
                np.maximum.at(last, w.doc[hit], at_word[hit])
                for r in np.unique(w.doc[hit]).tolist():
                    base_labels[r].add(label)
            labels, score = [set(x) for x in base_labels], [0.8 if x else 0.0 for x in base_labels]
            if n:
                held = held_keywords(w)
                raw = plain.tobytes()
                for r, words in held.items():
                    if any(words.issuperset(rule.keywords) for rule in rules()):
                        text = b" ".join(raw[off[r] : off[r + 1]].split()).decode("utf-8")
                        more, s, _ = detect(text, words)
                        labels[r] |= more
                        score[r] = max(score[r], s)
            has = total > 0
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(w.per_row, pa.int64()), pa.array(total), pa.array(first, mask=~has), pa.array(last, pa.int64(), mask=~has), pa.array([",".join(sorted(x)) for x in base_labels], pa.string()), pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(kit.table(spark, sf_dir, "documents"))
