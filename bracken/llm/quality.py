"""Quality rules: repetition and length rules plus a hashed n-gram logistic regression.

The rules drop very short and very repetitive texts. What they pass is judged by a logistic regression over hashed
word 1- and 2-grams and character 4-grams (relative frequencies), fitted on labelled rows, with its probability
calibrated on labelled rows that the fit did not see, and compared with a fixed threshold.

The fit uses a bounded sample (`sample_rows` labelled rows, by hash of doc_id); all counts and all scores cover whole
texts of all rows.

Defined results: a null or empty text has no words and fails the rules; a null doc_id is kept as it is and never
labelled; repeated doc_ids give repeated rows; extra columns are ignored; without labelled rows of both classes the
model accepts every text, so the rules alone decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _kit as kit

WORD_DIMS = CHAR_DIMS = 1 << 15
SAMPLE_ROWS = 6000
#: A text stays if the calibrated probability of good quality reaches this.
KEEP_FROM = 0.4
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double"


def _features(buf, off):
    """Bucket ids and rows of word 1-/2-grams and of character 4-grams."""
    w = kit.Words(buf, off)
    two = kit.grams(w.hash, 2)[kit.inside(w.bounds, 2, len(w.start))]
    two_row = w.doc[: max(0, len(w.start) - 1)][kit.inside(w.bounds, 2, len(w.start))]
    word = np.concatenate([w.hash, two]) & np.uint64(WORD_DIMS - 1)
    cp, first = kit.points(buf, off)
    ok = kit.inside(first, 4, len(cp))
    char = kit.grams(cp.astype(np.uint64), 4)[ok] & np.uint64(CHAR_DIMS - 1)
    char_row = np.repeat(np.arange(len(off) - 1), np.maximum(0, np.diff(first) - 3))
    return w, word.astype(np.int64), np.concatenate([w.doc, two_row]), char.astype(np.int64), char_row


def raw_scores(model: dict, buf, off, feats=None) -> np.ndarray:
    _, word, word_row, char, char_row = feats or _features(buf, off)
    rows = len(off) - 1
    z = np.full(rows, model["bias"])
    for ids, row, weights in ((word, word_row, model["word"]), (char, char_row, model["char"])):
        n = np.maximum(1, np.bincount(row, minlength=rows))
        z += np.bincount(row, weights=weights[ids], minlength=rows) / n
    return z


def _probability(model, z):
    return 1 / (1 + np.exp(-np.clip(model["a"] * z + model["b"], -40, 40)))


def fit_model(texts: list[str | None], labels: list[int], steps: int = 80) -> dict:
    """Logistic regression by full-batch Adam, then Platt scaling on every fifth row."""
    y = np.asarray(labels, np.float64)
    n_dims = WORD_DIMS + CHAR_DIMS
    model = {"word": np.zeros(WORD_DIMS, np.float32), "char": np.zeros(CHAR_DIMS, np.float32), "bias": 0.0, "a": 0.0, "b": 40.0}
    if len(y) < 10 or y.min() == y.max():
        return model
    rows, cols, vals = [], [], []
    column = pa.array([t or "" for t in texts], pa.large_string())
    at = 0
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    for part in kit.slices([batch]):
        buf, off = kit.utf8(part.column(0))
        _, word, wr, char, cr = _features(buf, off)
        n = len(off) - 1
        for ids, row, shift, dims in ((word, wr, 0, WORD_DIMS), (char, cr, WORD_DIMS, CHAR_DIMS)):
            size = np.maximum(1, np.bincount(row, minlength=n))
            key, c = np.unique(row * dims + ids, return_counts=True)
            rows.append((key // dims + at).astype(np.int32))
            cols.append((key % dims + shift).astype(np.int32))
            vals.append((c / size[key // dims]).astype(np.float32))
        at += n
    row, col, val = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
    train = np.arange(len(y)) % 5 != 0
    weight = np.where(train, 1.0, 0.0)
    weight[train & (y == 0)] *= np.sqrt((y == 1).sum() / max(1, (y == 0).sum()))
    theta, bias = np.zeros(n_dims), 0.0
    m = np.zeros(n_dims + 1)
    v = np.zeros(n_dims + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=theta[col] * val, minlength=len(y)) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight / weight.sum()
        grad = np.append(np.bincount(col, weights=g[row] * val, minlength=n_dims) + 1e-7 * theta, g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        move = 0.5 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        theta -= move[:-1]
        bias -= move[-1]
    z = np.bincount(row, weights=theta[col] * val, minlength=len(y)) + bias
    model |= {"word": theta[:WORD_DIMS].astype(np.float32), "char": theta[WORD_DIMS:].astype(np.float32), "bias": float(bias)}
    model["a"], model["b"] = platt(z[~train], y[~train])
    return model


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic calibration, with smoothed targets (Newton steps)."""
    if not len(z) or y.min() == y.max():
        return 1.0, 0.0
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    scale = max(1e-9, np.abs(z).max())
    x = np.stack([z / scale, np.ones_like(z)])
    ab = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(ab @ x, -40, 40)))
        h = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        ab -= np.linalg.solve(h, x @ (p - t) + 1e-6 * ab)
    return float(ab[0] / scale), float(ab[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, where=None) -> DataFrame:
    """At most `rows` labelled (doc_id, text, y), by hash of doc_id; only their ids are broadcast."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    ids = ids if where is None else ids.where(where)
    ids = ids.groupBy("doc_id").agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y")


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """Fits on one task over the bounded sample; only the model's fixed-size weights come to the driver."""

    def fit(batches):
        got = pa.Table.from_batches(list(batches)).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        m = fit_model(got["text"].to_pylist(), got["y"].to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([m[k].tobytes()]) if k in ("word", "char") else pa.array([float(m[k])]) for k in ("word", "char", "bias", "a", "b")], ["word", "char", "bias", "a", "b"])

    sample = labelled_sample(docs, labels, "quality", rows).repartition(1)
    got = sample.mapInArrow(lambda b: fit(x) if (x := [y for y in b if y.num_rows]) else iter(()), "word binary, char binary, bias double, a double, b double").collect()
    if not got:
        return fit_model([], [])
    r = got[0]
    return {"word": np.frombuffer(r.word, np.float32), "char": np.frombuffer(r.char, np.float32), "bias": r.bias, "a": r.a, "b": r.b}


def _dup_lines(buf, off, w: kit.Words) -> np.ndarray:
    """Lines (split at \\n) that hold a word and equal an earlier line of their text."""
    rows = len(off) - 1
    nl = np.flatnonzero(buf == 10)
    start = np.unique(np.concatenate([off[:-1], nl + 1]))
    row_of = np.searchsorted(off, start, side="right") - 1
    keep = (start < off[-1]) & (row_of < rows)
    start, row_of = start[keep], row_of[keep]
    stop = np.concatenate([start[1:], off[-1:]])
    stop = np.minimum(stop, off[row_of + 1])
    stop = stop - ((stop > start) & (buf[np.maximum(stop - 1, 0)] == 10))
    has_word = np.searchsorted(w.start, stop) > np.searchsorted(w.start, start)
    which = kit.kinds(buf, start[has_word], stop[has_word])[1]
    r = row_of[has_word]
    o = np.lexsort((which, r))
    again = np.zeros(len(o), bool)
    again[1:] = (which[o][1:] == which[o][:-1]) & (r[o][1:] == r[o][:-1])
    return np.bincount(r[o][again], minlength=rows)


def _equal_windows(w: kit.Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the windows that start at words a and b have equal words, byte by byte."""
    same = w.doc[a] == w.doc[b]
    size = w.end - w.start
    for k in range(WINDOW):
        same &= size[a + k] == size[b + k]
        left = np.flatnonzero(same)
        same[left] = kit.same_spans(w.buf, w.start[a[left] + k], w.start[b[left] + k], size[a[left] + k])
    return same


def _repeat_words(w: kit.Words, rows: int) -> np.ndarray:
    """Words covered by windows of five words that stand at least twice in their text."""
    n = len(w.start)
    ok = kit.inside(w.bounds, WINDOW, n)
    at = np.flatnonzero(ok)
    if not len(at):
        return np.zeros(rows, np.int64)
    h = kit.grams(w.hash, WINDOW)[at]
    h = kit.mix(h + w.doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    o = np.argsort(h, kind="stable")
    s = h[o]
    same = s[1:] == s[:-1]
    pair = np.flatnonzero(same)
    if not _equal_windows(w, at[o[pair]], at[o[pair + 1]]).all():
        # Unlike windows of one hash: the words' own numbers tell them apart.
        ids = w.ids
        _, h = np.unique(np.stack([w.doc[at], *[ids[at + k] for k in range(WINDOW)]], 1), axis=0, return_inverse=True)
        o = np.argsort(h.reshape(-1), kind="stable")
        s = h.reshape(-1)[o]
        same = s[1:] == s[:-1]
    twice = np.zeros(len(o), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(n + 1, np.int32)
    hit = at[o[twice]]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    return kit.counts(np.cumsum(cover[:-1]) > 0, w.bounds)


def rule_counts(buf, off, w: kit.Words | None = None) -> dict[str, np.ndarray]:
    w = w or kit.Words(buf, off)
    rows = len(off) - 1
    lead = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
    out = {
        "n_words": w.per_row.astype(np.int64),
        "word_chars": kit.sums(lead[w.end] - lead[w.start], w.bounds).astype(np.int64),
        "n_symbols": kit.counts(_SYMBOL[buf], off),
        "n_dup_lines": _dup_lines(buf, off, w).astype(np.int64),
        "n_repeat_words": _repeat_words(w, rows).astype(np.int64),
    }
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEATED_PERCENT * out["n_words"])
    return out


def judge(docs: DataFrame, model: dict, keep_from: float = KEEP_FROM, carry: bool = False) -> DataFrame:
    """Rule counts, calibrated quality and verdict of every row; carry: the input's columns too, of kept rows only."""

    def run(batches):
        for part in kit.slices(batches):
            buf, off = kit.utf8(part.column(part.schema.get_field_index("text")))
            feats = _features(buf, off)
            got = rule_counts(buf, off, feats[0])
            p = _probability(model, raw_scores(model, buf, off, feats))
            kept = ~got["base_failed"] & (p >= keep_from)
            if carry:
                yield part.filter(pa.array(kept))
                continue
            cols = [part.column(part.schema.get_field_index("doc_id"))] + [pa.array(got[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")] + [pa.array(kept), pa.array(p)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"])

    if carry:
        return docs.mapInArrow(run, docs.schema)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = kit.table(spark, sf_dir, "documents")
    return judge(docs, train(docs, kit.table(spark, sf_dir, "labels")))
