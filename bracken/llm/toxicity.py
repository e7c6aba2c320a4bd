"""Toxicity by noisy-channel deobfuscation and a lexicon learnt from labels.

1. A character trigram model counts letters over all documents (`letter_counts`); its table has ALPHABET**3 cells.
2. Words that look disguised (a look-alike sign and a letter, wherever they stand, three like letters in a row, letters set
   apart by blanks, dots or dashes) become a lattice: each sign may stand for itself or for a letter, a repeated letter or a separator may
   be dropped, each at a cost. Viterbi decoding finds the path of least cost under the trigram model.
3. Restored words join the text's own. A lexicon of words and 5-letter grams, weighed by log odds between toxic and other
   labelled documents, gives each word its evidence; an isotonic function of the strongest and the summed evidence, fitted
   on labelled rows that the lexicon did not see, gives the score.

The lexicon is fitted on a bounded sample (`sample_rows` labelled rows of the training part, by hash of doc_id); the
trigram model and the scores cover whole texts of all rows.

Defined results: a null or empty text has no evidence and gets the score of a text without any; a null doc_id is scored,
is not held out and trains nothing; equal texts get equal scores; extra columns are ignored; without labels of both
kinds every score is 0.
"""

from __future__ import annotations

import pickle
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _kit as kit, quality

SAMPLE_ROWS = 12_000
TOXIC_FROM = 0.7
#: Letters of the model: a to z, the accented letters of western European languages, and one for all other letters.
LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáãåæçéèêëíìîïñóòôöõøœúùûüßý"
OTHER = len(LETTERS) + 1
ALPHABET = OTHER + 1  # 0 is whatever is not a letter
#: Signs that stand for letters, and what reading them so costs (natural log units).
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c"}
LOOK_COST, DROP_REPEAT_COST, DROP_SIGN_COST, KEEP_SIGN_COST = 1.0, 0.7, 0.5, 12.0
GRAM = 5


@cache
def _codes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    place = {ch: i + 1 for i, ch in enumerate(LETTERS)}
    for i in range(0x30000):
        ch = chr(i)
        if 0xD800 <= i <= 0xDFFF or unicodedata.category(ch)[0] != "L":
            continue
        low = ch.lower()
        out[i] = place.get(low if len(low) == 1 else ch, OTHER)
    return out


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all documents; at most ALPHABET**3 sums come to the driver."""

    def run(batches):
        total = np.zeros(ALPHABET**3, np.int64)
        for part in kit.slices(batches):
            buf, off = kit.utf8(part.column(0))
            cp, first = kit.points(buf, off)
            c = _codes()[cp].astype(np.int32)
            c = np.insert(c, first, 0)
            if len(c) > 2:
                total += np.bincount(c[:-2] * ALPHABET**2 + c[1:-1] * ALPHABET + c[2:], minlength=ALPHABET**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["code", "n"])

    out = np.zeros(ALPHABET**3, np.int64)
    rows = docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out[rows["code"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


class Channel:
    """Restores disguised words under a trigram model."""

    def __init__(self, counts: np.ndarray):
        t = counts.reshape(ALPHABET, ALPHABET, ALPHABET).astype(np.float64)
        two, one = t.sum(0) + 1e-9, t.sum((0, 1)) + 1
        one = one / one.sum()
        two = (two + 20 * one) / (two + 20 * one).sum(1, keepdims=True)
        p = (t + 20 * two[None]) / (t.sum(2, keepdims=True) + 20)
        self.cost = (-np.log(np.maximum(p, 1e-12))).round(3).tolist()
        self.place = {ch: i + 1 for i, ch in enumerate(LETTERS)}
        self.memory: dict[tuple[str, bool], str] = {}

    def restore(self, word: str, read: bool = False) -> str:
        """The word behind a disguise. read: look-alike signs are letters and are not dropped, unless repeated."""
        got = self.memory.get((word, read))
        if got is None:
            if len(self.memory) > 200_000:
                self.memory.clear()
            got = self.memory[word, read] = self._viterbi(word, read)
        return got

    def _viterbi(self, word: str, read: bool = False) -> str:
        states = {(0, 0): (0.0, None)}  # two codes before -> cost, path
        cost, before = self.cost, ""
        for ch in word.lower():
            options = []
            own = self.place.get(ch)
            if own:
                options.append((0.0, own, ch))
            elif ch.isalpha():
                options.append((0.0, OTHER, ch))
            for x in LOOKS.get(ch, ""):
                options.append((LOOK_COST, self.place[x], x))
            skip = DROP_REPEAT_COST if ch == before else None if own or ch.isdigit() or read and ch in LOOKS else DROP_SIGN_COST
            if not options and skip is None:
                options.append((KEEP_SIGN_COST, 0, ch))
            new: dict = {}
            for (a, b), (c, path) in states.items():
                row = cost[a][b]
                for extra, code, shown in options:
                    v = c + extra + row[code]
                    key = (b, code)
                    if key not in new or v < new[key][0]:
                        new[key] = (v, (path, shown))
                if skip is not None:
                    v = c + skip
                    if (a, b) not in new or v < new[(a, b)][0]:
                        new[(a, b)] = (v, path)
            states, before = new, ch
        best = min(((c + self.cost[a][b][0], path) for (a, b), (c, path) in states.items()), key=lambda x: x[0])[1]
        out = []
        while best:
            best, shown = best
            out.append(shown)
        return "".join(reversed(out))


@cache
def _signs() -> np.ndarray:
    """Of each code point: 1 a letter, 2 a look-alike sign, 3 a separator."""
    out = (_codes() > 0).astype(np.uint8)
    out[[ord(ch) for ch in LOOKS]] = 2
    out[[ord(ch) for ch in ".-_*~'"]] = 3
    return out


#: What is taken off a word's ends; the second has look-alike signs too.
_ENDS, _ALL_ENDS = ".,;:?\"')[]{}<>#%&*", ".,;:?!\"'()[]{}<>#%&*"


def disguised(buf: np.ndarray, off: np.ndarray) -> list[tuple[int, str, str]]:
    """(row, disguised word, the same without signs of punctuation, empty for letters set apart) of the texts; blanks between single letters are taken out."""
    w = kit.Words(buf, off)
    n = len(w.start)
    if not n:
        return []
    cp, _ = kit.points(buf, off)
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    solid = ~kit._SPACE[buf[lead]]
    cp, lead = cp[solid], lead[solid]
    kind, code = _signs()[cp], _codes()[cp]
    word_of = np.searchsorted(w.start, lead, side="right") - 1
    has = [np.bincount(word_of[kind == k], minlength=n) for k in (1, 2)]
    flag = (has[0] > 0) & (has[1] > 0)  # a look-alike sign and a letter, wherever they stand
    # A separator with a letter on both sides, perhaps beyond other signs.
    where = np.arange(len(cp))
    letter = kind == 1
    last = np.maximum.accumulate(np.where(letter, where, -1))
    nxt = np.minimum.accumulate(np.where(letter, where, len(cp))[::-1])[::-1]
    sign = np.flatnonzero(kind == 3)
    sign = sign[(last[sign] >= 0) & (nxt[sign] < len(cp)) & (nxt[sign] - last[sign] <= 4)]
    sign = sign[(word_of[last[sign]] == word_of[sign]) & (word_of[nxt[sign]] == word_of[sign])]
    flag[word_of[sign]] = True
    three = np.flatnonzero((code[2:] > 0) & (code[2:] < OTHER) & (code[2:] == code[1:-1]) & (code[2:] == code[:-2]) & (word_of[2:] == word_of[:-2])) + 2
    flag[word_of[three]] = True
    out = []
    raw = buf.tobytes()
    for i in np.flatnonzero(flag).tolist():
        word = raw[w.start[i] : w.end[i]].decode("utf-8")
        out.append((int(w.doc[i]), word.strip(_ENDS), word.strip(_ALL_ENDS)))
    # Single letters and signs set apart by blanks, perhaps with separators between them.
    first = np.searchsorted(lead, w.start)
    one = kind[first]
    single = (np.bincount(word_of, minlength=n) == 1) & (one > 0)
    edge = np.ones(n, bool)
    edge[1:] = (single[1:] != single[:-1]) | (w.doc[1:] != w.doc[:-1])
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], n)
    told = np.zeros(n + 1, np.int64)
    np.cumsum(one < 3, out=told[1:])
    good = single[starts] & (told[ends] - told[starts] >= 3)
    for a, b in zip(starts[good].tolist(), ends[good].tolist()):
        word = "".join(map(chr, cp[first[a:b]].tolist()))
        out.append((int(w.doc[a]), word, ""))
    return out


def restored(buf: np.ndarray, off: np.ndarray, channel: Channel) -> list[tuple[int, str]]:
    """(row, restored word) of the disguised words; a plain word with punctuation at its ends is none.

    Where dropping a sign is cheaper than reading it (`a$$` is near `a`), the form with all signs read is given too. Signs
    that may be a plain word's punctuation (`!` at its ends, an opening bracket) are only read where that is cheaper.
    """
    out = []
    for row, word, bare in disguised(buf, off):
        plain = bare.lower()
        forms = dict.fromkeys(channel.restore(x) for x in (word, bare) if x)
        if not bare.isalpha() and any(ch in LOOKS for ch in bare or word):
            forms |= dict.fromkeys(channel.restore(x, True) for x in (word, bare) if x)
        out += [(row, x) for x in forms if x and not (x == plain and x.isalpha())]
    return out


def _features(buf, off, channel: Channel):
    """Rows, word hashes, and for every gram its hash and its word; restored words come after the text's own."""
    extra = restored(buf, off, channel)
    cp, first = kit.points(buf, off)
    more = np.frombuffer(" ".join([x for _, x in extra]).encode("utf-32-le"), np.uint32)
    c = _codes()[np.concatenate([cp, np.full(1, 32, np.uint32), more])]
    row = np.concatenate([np.repeat(np.arange(len(off) - 1), np.diff(first)), [0], np.repeat([r for r, _ in extra], [len(x) + 1 for _, x in extra])[: len(more)]]).astype(np.int64)
    solid = c > 0
    start = np.flatnonzero(solid & np.append(True, ~solid[:-1] | (row[1:] != row[:-1])))
    end = np.flatnonzero(solid & np.append(~solid[1:] | (row[1:] != row[:-1]), True)) + 1
    words = kit.span_hashes(c, start, end)
    x = kit.BYTE_KEYS[c]
    g = kit.grams(x, GRAM)
    inner = np.zeros(len(c) + 1, np.int64)
    np.cumsum(~solid, out=inner[1:])
    gaps = inner[GRAM:] - inner[:-GRAM] - ~solid[: len(c) - GRAM + 1] if len(c) >= GRAM else np.zeros(0, int)
    at = np.flatnonzero(gaps == 0)
    at = at[solid[at + 1]] if len(at) else at
    word_of = np.searchsorted(start, at + 1, side="right") - 1
    return row[start] if len(start) else start, words, g[at], word_of


def _lexicon_of(h, row, y, least: int, odds: float):
    o = np.lexsort((row, h))
    h, row = h[o], row[o]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, t = h[new], y[row[new]] == 1
    cut = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
    if not len(cut):
        return np.zeros(0, np.uint64), np.zeros(0)
    pos = np.add.reduceat(t.astype(np.int64), cut)
    neg = np.add.reduceat((~t).astype(np.int64), cut)
    lo = np.log((pos + 0.2) / ((y == 1).sum() + 0.4)) - np.log((neg + 0.2) / ((y == 0).sum() + 0.4))
    lo -= 2 / np.sqrt(np.maximum(pos, 1))  # rare features are less sure
    keep = (pos >= least) & (lo >= odds)
    return h[cut[keep]], lo[keep]


def _lexicon(parts, y, least: int = 4, odds: float = 3.5):
    """Sorted hashes and weights of features that come mostly in toxic documents.

    parts: (hashes, rows) pairs; rows of y = -1 do not count. Done in 16 ranges of hashes, so that sorting takes little.
    """
    found = []
    for s in range(16):
        hs, rows = [], []
        for h, row in parts:
            at = np.flatnonzero((h >> np.uint64(60)) == s)
            at = at[y[row[at]] >= 0]
            hs.append(h[at])
            rows.append(row[at])
        found.append(_lexicon_of(np.concatenate(hs), np.concatenate(rows), y, least, odds))
    return np.concatenate([h for h, _ in found]), np.concatenate([w for _, w in found])


class Filter:
    """Weights by hash, with a bitmap in front."""

    def __init__(self, hashes, weights):
        self.hashes, self.weights = hashes, weights
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, h):
        out = np.zeros(len(h))
        at = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)]) if len(self.hashes) else []
        if len(at):
            i = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            out[at] = np.where(self.hashes[i] == h[at], self.weights[i], 0)
        return out


def _evidence(rows: int, feats, words: Filter, grams: Filter) -> np.ndarray:
    """(strongest, log of 1 + summed) evidence of each row."""
    row, w, g, of = feats
    e = words(w)
    np.maximum.at(e, of, grams(g))
    top, total = np.zeros(rows), np.zeros(rows)
    hit = np.flatnonzero(e)
    np.maximum.at(top, row[hit], e[hit])
    np.add.at(total, row[hit], e[hit])
    return np.stack([top, np.log1p(total)], 1)


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing function of z nearest to y, by pooling adjacent violators."""
    z, of = np.unique(z, return_inverse=True)
    n, t = np.bincount(of).astype(float), np.bincount(of, weights=y)
    pools: list[list[float]] = []  # first z, last z, positives, rows
    for a, k, m in zip(z, t, n):
        pools.append([a, a, k, m])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    at = np.array([x for p in pools for x in (p[0], p[1])])
    value = np.array([(p[2] + 0.02) / (p[3] + 0.04) for p in pools for _ in range(2)])
    return at, np.maximum.accumulate(value)


def probability(model: dict, z: np.ndarray) -> np.ndarray:
    """The calibrated probability; a hundredth of it follows z itself, so that higher z never ties."""
    at, value = model["knots"]
    return 0.99 * np.interp(z, at, value) + 0.01 * z / (z + 10) if len(at) else np.zeros(len(z))


def fit_model(texts, labels, counts) -> dict:
    y = np.asarray(labels)
    none = {"words": (np.zeros(0, np.uint64), np.zeros(0)), "grams": (np.zeros(0, np.uint64), np.zeros(0)), "knots": (np.zeros(0), np.zeros(0))}
    if len(y) < 10 or y.min() == y.max():
        return none
    channel = Channel(counts)
    words, grams, kept, at = [], [], [], 0
    held = np.arange(len(y)) % 4 == 0
    for part in kit.slices([pa.RecordBatch.from_arrays([pa.array([t or "" for t in texts], pa.large_string())], ["text"])]):
        buf, off = kit.utf8(part.column(0))
        row, w, g, of = _features(buf, off, channel)
        words.append((w, (row + at).astype(np.int32)))
        grams.append((g, (row[of] + at).astype(np.int32)))
        # Of held rows, which gram is in which word is kept too.
        mine = held[at + np.arange(len(off) - 1)]
        a, b = mine[row], mine[row[of]]
        kept.append((mine, row[a], w[a], g[b], (np.cumsum(a) - 1)[of[b]].astype(np.int32)))
        at += len(off) - 1
    # The first lexicon comes from three rows of four; its evidence on the fourth sets the function of evidence.
    seen = np.where(held, -1, y)
    first = Filter(*_lexicon(words, seen)), Filter(*_lexicon(grams, seen))
    z = np.concatenate([_evidence(len(mine), feats, *first).sum(1)[mine] for mine, *feats in kept])
    return {"words": _lexicon(words, y), "grams": _lexicon(grams, y), "knots": isotonic(z, (y[held] == 1).astype(float))}


def train(docs: DataFrame, labels: DataFrame, counts: np.ndarray, rows: int = SAMPLE_ROWS) -> dict:
    """Fits on one task over the bounded sample of rows whose crc32(doc_id as text) mod 3 is not 1."""
    part = F.crc32(F.col("doc_id").cast("long").cast("string")) % 3 != 1
    sample = quality.labelled_sample(docs, labels, "toxic", rows, part).repartition(1)

    def fit(batches):
        got = pa.Table.from_batches(list(batches)).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        if got.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_model(got["text"].to_pylist(), got["y"].to_pylist(), counts))])], ["model"])
        kit.release()

    got = sample.mapInArrow(fit, "model binary").collect()
    return pickle.loads(got[0].model) if got else fit_model([], [], counts)


def scores(docs: DataFrame, model: dict, counts: np.ndarray, toxic_from: float = TOXIC_FROM, carry: bool = False) -> DataFrame:
    """Scores of every row; carry: the input's columns of rows below the threshold instead."""

    def run(batches):
        channel, words, grams = Channel(counts), Filter(*model["words"]), Filter(*model["grams"])
        for part in kit.slices(batches):
            buf, off = kit.utf8(part.column(part.schema.get_field_index("text")))
            z = _evidence(len(off) - 1, _features(buf, off, channel), words, grams).sum(1)
            p = probability(model, z)
            if carry:
                yield part.filter(pa.array(p < toxic_from))
            else:
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p), pa.array((p >= toxic_from).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    if carry:
        return docs.mapInArrow(run, docs.schema)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 3 == 1, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(spark, sf_dir: str) -> DataFrame:
    docs = kit.table(spark, sf_dir, "documents")
    counts = letter_counts(docs)
    return scores(docs, train(docs, kit.table(spark, sf_dir, "labels"), counts), counts)
