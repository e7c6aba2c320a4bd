"""N-gram Jaccard join by chosen paths.

A text's set is its distinct shingles of five words (a shorter text has the one shingle of all its words); equal sets are
one node. Each of `RUNS` runs grows a tree of paths over a node's set: at the root and again at each child it picks the
WIDTH shingles of least hash under a hash of that place in the tree, so that similar sets pick alike. Two sets with
similarity 0.8 miss each other in a run with a chance of about 0.012; RUNS follows from TARGET.

1. Paths are dealt to buckets. A bucket drops paths with one node and compares the others by 128-bit sketches with a bound
   so loose that a pair at the threshold fails it with a chance below 1e-8. It sends a spanning forest, not pairs.
2. Nodes joined by the forests form candidate components (contraction in the cluster, one checkpoint a round).
3. Each component gets its sets once and counts exact similarities of all its pairs; components of over CELL nodes are
   dealt out as pairs of blocks. Links are counted, not sent; classes come from a spanning forest again.

Result, per row: doc_id, class_id (least doc_id of its class) and n_links (rows with similarity of at least 0.8 to it).

Defined results: a text without words (null, empty) is a class of its own without links; a null doc_id is a class of its
own (class_id null) without links and links to none; rows of the same doc_id are told apart by their texts; equal rows get
equal results and link to each other; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import _kit as kit
from .packing import drop, saved

SHINGLE, SIMILAR = 5, 0.8
TARGET, MISS = 0.99999, 0.012
RUNS = math.ceil(math.log(1 - TARGET) / math.log(MISS))
WIDTH = 3
SKETCH = 64
#: Sketch places that may differ: a pair at 0.8 differs in 64 * 0.2 * 3/4 = 9.6 on average, and in more than this with
#: a chance below 1e-8.
MAY_DIFFER = 27
CELL = 1024
BROADCAST_ROWS = 500_000
_NODE, _DOC, _GONE = "__node", "__doc", "__gone"  # no columns of a table


def _sets(buf, off):
    """Distinct shingle hashes of each row, row by row in order of hash, and the rows' first places."""
    w = kit.Words(buf, off)
    rows = len(off) - 1
    ok = kit.inside(w.bounds, SHINGLE, len(w.start))
    at = np.flatnonzero(ok)
    h, row = (kit.grams(w.hash, SHINGLE)[at], w.doc[at]) if len(at) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    short = np.flatnonzero((w.per_row > 0) & (w.per_row < SHINGLE))
    if len(short):
        one = []
        for r in short.tolist():
            own = w.hash[w.bounds[r] : w.bounds[r + 1]]
            one.append(int(kit.grams(own, len(own))[0]) ^ len(own))
        h, row = np.append(h, np.array(one, np.uint64)), np.append(row, short)
    o = np.lexsort((h, row))
    h, row = h[o], row[o]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(rows + 1))


def _seed(*place: int) -> np.uint64:
    return kit.mix(np.array([sum((x + 1) * 7919 ** (i + 1) for i, x in enumerate(place)) % 2**64], np.uint64))[0]


def _least(h, bounds, k):
    """The k places of least value in each row (of at least one), as (rows, k) with -1 where there are fewer."""
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    o = np.lexsort((h, row))
    at = bounds[:-1, None] + np.arange(k)[None]
    good = np.arange(k)[None] < n[:, None]
    return np.where(good, o[np.minimum(at, max(0, len(o) - 1))] if len(o) else -1, -1)


def _describe(batches):
    """Set id, size, sketch and paths of each row."""
    for part in kit.slices(batches, most=1 << 20):
        buf, off = kit.utf8(part.column(1))
        h, b = _sets(buf, off)
        size = np.diff(b)
        rows = len(size)
        ident = _names(h, b)
        full = np.flatnonzero(size)
        sketch = np.zeros((rows, 2), np.uint64)
        if len(full):
            for k in range(SKETCH):
                least = np.minimum.reduceat(kit.mix(h ^ _seed(2, k)), b[:-1][full])
                bits = (kit.mix(least) & np.uint64(3)) << np.uint64(2 * (k % 32))
                sketch[full, k // 32] |= bits
        paths = np.zeros((rows, RUNS * WIDTH * WIDTH), np.uint64)
        valid = np.zeros(paths.shape, bool)
        col = 0
        for r in range(RUNS):
            top = _least(kit.mix(h ^ _seed(3, r)), b, WIDTH)
            for i in range(WIDTH):
                root = np.where(top[:, i] >= 0, h[np.maximum(top[:, i], 0)] if len(h) else 0, 0).astype(np.uint64)
                under = kit.mix(root + _seed(4, r))
                child = kit.mix(h ^ np.repeat(under, size))
                child[top[:, i][top[:, i] >= 0]] = np.uint64(2**64 - 1)  # the root's own shingle comes last
                low = _least(child, b, WIDTH)
                for j in range(WIDTH):
                    leaf = h[np.maximum(low[:, j], 0)] if len(h) else np.zeros(rows, np.uint64)
                    paths[:, col] = kit.mix(under ^ kit.mix(leaf))
                    valid[:, col] = (top[:, i] >= 0) & (low[:, j] >= 0)
                    col += 1
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(valid.sum(1))), pa.int32()), pa.array(paths[valid].view(np.int64)))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ident), pa.array(size.astype(np.int32)), pa.array(sketch[:, 0].view(np.int64)), pa.array(sketch[:, 1].view(np.int64)), lists], ["doc_id", "node", "size", "s0", "s1", "paths"])


def _names(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The node of each set."""
    return kit.mix(kit_sum(kit.mix(h ^ _seed(1)), bounds) + np.diff(bounds).astype(np.uint64)).view(np.int64)


def kit_sum(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _differ(a0, a1, b0, b1):
    """Sketch places in which two sketches differ."""
    odd = np.uint64(0x5555555555555555)
    x, y = a0 ^ b0, a1 ^ b1
    return np.bitwise_count((x | (x >> np.uint64(1))) & odd).astype(np.int16) + np.bitwise_count((y | (y >> np.uint64(1))) & odd)


class _Forest:
    def __init__(self, n):
        self.parent = list(range(n))

    def root(self, x):
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _joined(s0, s1, size):
    """Pairs (a, b) of one bucket that span what its passing pairs connect."""
    n = len(s0)
    forest = _Forest(n)
    alive = np.arange(n)
    leaders: list[int] = []
    members: list[np.ndarray] = []
    radius: list[int] = []
    near = 8  # places: such sets hang on their leader, and are compared with other leaders' sets only
    while len(alive):
        a = alive[0]
        d = _differ(s0[a], s1[a], s0[alive], s1[alive])
        fits = (np.minimum(size[alive], size[a]) >= SIMILAR * np.maximum(size[alive], size[a]))
        own = alive[(d <= near) & fits]
        for x in own[1:].tolist():
            forest.join(int(a), x)
        leaders.append(int(a))
        members.append(own)
        radius.append(int(d[(d <= near) & fits].max()))
        alive = alive[(d > near) | ~fits]
    if len(leaders) > 1:
        lead, wide = np.array(leaders), np.array(radius)
        for i in range(len(leaders) - 1):
            rest = np.arange(i + 1, len(leaders))
            d = _differ(s0[lead[i]], s1[lead[i]], s0[lead[rest]], s1[lead[rest]])
            for j in rest[d <= MAY_DIFFER + wide[i] + wide[rest]].tolist():
                if forest.root(leaders[i]) == forest.root(leaders[j]):
                    continue
                small, large = sorted((members[i], members[j]), key=len)
                for x in small.tolist():
                    hit = (_differ(s0[x], s1[x], s0[large], s1[large]) <= MAY_DIFFER) & (np.minimum(size[x], size[large]) >= SIMILAR * np.maximum(size[x], size[large]))
                    if hit.any():
                        forest.join(x, int(large[np.argmax(hit)]))
                        break
    return [(forest.root(x), x) for x in range(n) if forest.root(x) != x]


def _candidates(t: pa.Table) -> pa.Table:
    """Spanning edges of a group of paths."""
    path, node, size = (t[k].to_numpy() for k in ("path", "node", "size"))
    s0, s1 = (t[k].to_numpy().view(np.uint64) for k in ("s0", "s1"))
    o = np.lexsort((node, path))
    path, node, size, s0, s1 = path[o], node[o], size[o], s0[o], s1[o]
    cut = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
    n = np.diff(np.append(cut, len(path)))
    two = cut[n == 2]
    ok = (_differ(s0[two], s1[two], s0[two + 1], s1[two + 1]) <= MAY_DIFFER) & (np.minimum(size[two], size[two + 1]) >= SIMILAR * np.maximum(size[two], size[two + 1]))
    a, b = [node[two[ok]]], [node[two[ok] + 1]]
    for i, k in zip(cut[n > 2].tolist(), n[n > 2].tolist()):
        own = slice(i, i + k)
        pairs = _joined(s0[own], s1[own], size[own])
        if pairs:
            x = np.array(pairs) + i
            a.append(node[x[:, 0]])
            b.append(node[x[:, 1]])
    a, b = np.concatenate(a), np.concatenate(b)
    e = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.table({"a": pa.array(e[:, 0], pa.int64()), "b": pa.array(e[:, 1], pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of (a, b) edges; label is the least node of the component.

    Each round hangs every node on its least neighbour, then on what that one hangs on, and contracts, until no edge is
    left. A round at least halves a path, however its nodes are ordered.
    """
    edges = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while edges.take(1):
        least = saved(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")))
        above = least.select(F.col("node").alias("up"), F.col("up").alias("top"))
        up = saved(least.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up")))
        if labels is None:
            nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
            now = saved(nodes.join(up, "node", "left").select("node", F.coalesce("up", "node").alias("label")))
        else:
            now = saved(labels.join(up.select(F.col("node").alias("label"), "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label")))
        ua, ub = up.select(F.col("node").alias("a"), F.col("up").alias("ua")), up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        nxt = edges.join(ub, "b").join(ua, "a", "left").select(F.coalesce("ua", "a").alias("x"), F.col("ub").alias("y")).where("x <> y")
        nxt = saved(nxt.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        for old in (edges, least, up, labels):
            if old is not None:
                drop(old)
        edges, labels = nxt, now
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels


def _exact(own: list[np.ndarray], other: list[np.ndarray] | None):
    """Boolean matrix of pairs with similarity of at least SIMILAR, between two lists of sets or within one."""
    sets = own + (other or [])
    size = np.array([len(x) for x in sets])
    token = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), size)
    o = np.argsort(token, kind="stable")
    token, doc = token[o], doc[o]
    cut = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    df = np.diff(np.append(cut, len(token)))
    column = np.repeat(np.cumsum(df > 1) - 1, df)
    keep = np.repeat(df > 1, df)
    column, doc = column[keep], doc[keep]
    m = len(own)
    both = np.zeros((m, len(other) if other is not None else m), np.float32)
    step = 2048
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        i, j = np.searchsorted(column, (c, c + step))
        x = np.zeros((len(sets), step), np.float32)
        x[doc[i:j], column[i:j] - c] = 1
        both += x[:m] @ (x[m:].T if other is not None else x.T)
    sizes = size[:m, None] + (size[m:] if other is not None else size)[None]
    return 10 * both >= 8 * (sizes - both) - 1e-3


def _verified(t: pa.Table) -> pa.Table:
    """Link counts and spanning edges of whole cells."""
    comp, i, j, block, node, n = (t[k].to_numpy() for k in ("comp", "i", "j", "block", "node", "n"))
    data = t["shingles"].to_pylist()
    o = np.lexsort((node, block, j, i, comp))
    key = np.stack([comp, i, j], 1)[o]
    cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
    out_node, out_links, out_to = [], [], []
    for a, b in zip(cut, np.append(cut[1:], len(o))):
        at = o[a:b]
        inner = i[at[0]] == j[at[0]]
        left = at if inner else at[block[at] == i[at[0]]]
        right = None if inner else at[block[at] != i[at[0]]]
        sets = lambda rows: [np.frombuffer(data[r], np.uint64) for r in rows]
        if not len(left) or right is not None and not len(right):
            continue
        hit = _exact(sets(left), None if inner else sets(right))
        if inner:
            np.fill_diagonal(hit, False)
        rows = np.append(left, right) if not inner else left
        links = np.concatenate([hit @ n[left if inner else right], [] if inner else hit.T @ n[left]])
        # Least node that each can reach inside the cell.
        label = node[rows].copy()
        m = len(left)
        while True:
            if inner:
                new = np.minimum(label, np.where(hit, label[None, :], np.iinfo(np.int64).max).min(1))
            else:
                x, y = label[:m], label[m:]
                new = np.append(np.minimum(x, np.where(hit, y[None, :], np.iinfo(np.int64).max).min(1)), np.minimum(y, np.where(hit, x[:, None], np.iinfo(np.int64).max).min(0)))
            if (new == label).all():
                break
            label = new
        out_node.append(node[rows])
        out_links.append(links)
        out_to.append(label)
    if not out_node:
        return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "label": pa.array([], pa.int64())})
    return pa.table({"node": np.concatenate(out_node), "links": np.concatenate(out_links).astype(np.int64), "label": np.concatenate(out_to)})


def _shingles(batches):
    for part in kit.slices(batches):
        h, b = _sets(*kit.utf8(part.column(part.schema.get_field_index("text"))))
        raw = [h[x:y].tobytes() for x, y in zip(b[:-1], b[1:])]
        yield pa.RecordBatch.from_arrays([part.column(k) for k in range(part.num_columns - 1)] + [pa.array(raw, pa.binary())], [*part.schema.names[:-1], "shingles"])


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links of every row."""
    linked, alone, unnamed = _classes(docs)
    return linked.drop("node").unionByName(alone).unionByName(unnamed)


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with words (doc_id, node, class_id, n_links), rows without, and rows without a doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = saved(docs.where("doc_id is not null").mapInArrow(_describe, "doc_id long, node long, size int, s0 long, s1 long, paths array<long>"))
    nodes = rows.where("size > 0").groupBy("node").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.first("size").alias("size"), F.first("s0").alias("s0"), F.first("s1").alias("s1"), F.first("paths").alias("paths"))
    nodes = saved(nodes)
    total = rows.count()
    groups = max(48, math.ceil(total * RUNS * WIDTH * WIDTH / 60_000))
    paths = nodes.select(F.explode("paths").alias("path"), "node", "size", "s0", "s1").withColumn("group", F.pmod(F.xxhash64("path"), F.lit(groups)))
    edges = paths.groupBy("group").applyInArrow(_candidates, "a long, b long")
    comp = components(edges)
    # Each candidate node's set, worked out from its first row's text.
    sized = comp.groupBy("label").agg(F.count("*").alias("m"))
    found = comp.join(sized, "label").join(nodes.select("node", "first", "n"), "node")
    blocks = F.ceil(F.col("m") / CELL).cast("long")
    found = saved(found.select("node", "first", "n", F.col("label").alias("comp"), blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).alias("block")))
    texts = docs.join(_small(found.withColumnRenamed("first", "doc_id")), "doc_id").select("node", "n", "comp", "blocks", "block", "text")
    sets = texts.mapInArrow(_shingles, "node long, n long, comp long, blocks long, block long, shingles binary")
    # A doc_id may stand on several rows: only the row with the node's own set counts, once.
    cells = sets.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("node", "n", "comp", "block", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "shingles")
    parts = max(48, math.ceil(total / 2000))
    cells = cells.withColumn("group", F.pmod(F.xxhash64("comp", "i", "j"), F.lit(parts)))
    got = saved(cells.groupBy("group").applyInArrow(_once, "node long, links long, label long"))
    links = got.groupBy("node").agg(F.sum("links").alias("links"))
    merged = components(got.select(F.col("node").alias("a"), F.col("label").alias("b")))
    node_info = nodes.select("node", "n", "first").join(links, "node", "left").join(merged.select("node", "label"), "node", "left").select("node", "n", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "node").alias("label"))
    node_info = saved(node_info)
    least = node_info.groupBy("label").agg(F.min("first").alias("class_id"))
    by_node = node_info.join(least, "label").select("node", "class_id", (F.col("links") + F.col("n") - 1).alias("n_links"))
    linked = rows.where("size > 0").select("doc_id", "node").join(by_node, "node").select("doc_id", "node", "class_id", "n_links")
    alone = rows.where("size = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    unnamed = docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked, alone, unnamed


def _small(rows: DataFrame) -> DataFrame:
    """Rows of a few numbers, to be broadcast if there are no more than BROADCAST_ROWS; else they are shuffled."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _once(t: pa.Table) -> pa.Table:
    """Drops sets that are not their node's (another row of the same doc_id) and repeats, then counts."""
    raw = t["shingles"].to_pylist()
    node = t["node"].to_numpy()
    keys = list(zip(node.tolist(), t["comp"].to_pylist(), t["i"].to_pylist(), t["j"].to_pylist()))
    seen, keep = set(), []
    for k, (key, x) in enumerate(zip(keys, raw)):
        h = np.frombuffer(x, np.uint64)
        own = kit.mix(np.array([kit.mix(h ^ _seed(1)).sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64)).view(np.int64)[0]
        if own == key[0] and key not in seen:
            seen.add(key)
            keep.append(k)
    return _verified(t.take(pa.array(keep, pa.int64())))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each class, of its least doc_id, with all its columns; rows without words or doc_id stay.

    Rows that share a doc_id are judged by their own texts; of repeats of one row, one stays.
    """
    linked = saved(_classes(docs)[0])
    gone = linked.where("doc_id <> class_id").select("doc_id", "node").distinct()
    if not linked.groupBy("doc_id").count().where("count > 1").take(1):
        return docs.join(_small(saved(gone.select("doc_id"))), "doc_id", "left_anti").select(*docs.columns)

    def named(batches):
        for part in kit.slices(batches):
            h, b = _sets(*kit.utf8(part.column(part.schema.get_field_index("text"))))
            yield part.append_column(_NODE, pa.array(_names(h, b), mask=np.diff(b) == 0))

    rows = docs.mapInArrow(named, StructType([*docs.schema.fields, StructField(_NODE, LongType())]))
    gone = gone.select(F.col("doc_id").alias(_DOC), F.col("node").alias(_GONE))
    kept = rows.join(_small(saved(gone)), (rows["doc_id"] == F.col(_DOC)) & (rows[_NODE] == F.col(_GONE)), "left_anti")
    nth = F.row_number().over(Window.partitionBy("doc_id", _NODE).orderBy("text"))
    alone = F.col(_NODE).isNull() | F.col("doc_id").isNull()
    return kept.where(alone).unionByName(kept.where(~alone).withColumn(_GONE, nth).where(F.col(_GONE) == 1).drop(_GONE)).select(*docs.columns)


def ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(kit.table(spark, sf_dir, "documents"))
