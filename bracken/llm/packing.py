"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents longer than a sequence are cut into whole sequences and one shorter first piece. A round takes all pieces that have
no place and all gaps, one row each:

1. If pieces are longer than every gap, sequences are opened: as many as those pieces need at least (in the first round half
   of that, so that equal ones can still pair). A gap that holds several of the longest piece stands in the sweep as that
   many slots.
2. Slots and pieces are range-sorted together by size, longest first, over the cluster; equal sizes are spread by hash.
3. Each partition sweeps its run: a piece takes its successor, the smallest slot before it that is still free. Pieces that
   want the same slot are told apart by their rank in the sort. What a partition cannot match is left over as a run of
   pieces, then a run of slots; from the partitions' counts of both (all that is gathered) follows which runs meet, and
   they are joined by rank.
4. Gaps shrink by what they took, and the next round follows until every piece has its place.

Rounds are few: every round fills each gap that can take a piece (five for the documents at hand). No group of equal lengths
is dealt to one task, and nothing grows on the driver but two counts a partition and the counts of lengths.

Defined results: null counts as empty; an empty document is its end token alone; equal rows are packed like any others;
extra columns are ignored; an empty table gives no rows. Sequence numbers are not meaningful beyond equality.
"""

from __future__ import annotations

import functools
import math
import re
import uuid
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import _kit as kit, bpe

CAPACITY, END = 1024, 2
#: Rows of a sweep's partition on average; in large tables up to MOST_SWEEP_ROWS, so that there are about SWEEPS of them.
SWEEP_ROWS, MOST_SWEEP_ROWS, SWEEPS = 50_000, 2_000_000, 4096


def needed(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """Sequences that pieces of these lengths take at least: by their sum, and by how many of the long ones fit in one."""
    by_sum = math.ceil(sum(n * m for n, m in counts.items()) / capacity)
    each = (math.ceil(sum(m for n, m in counts.items() if n * (k + 1) > capacity) / k) for k in range(1, 9))
    return max(by_sum, *each)


def bridges(pieces: dict[int, int], slots: dict[int, int]) -> tuple[dict, dict]:
    """Which left-over pieces and slots of sweep partitions meet: {partition: runs (first, end, number of the first)}.

    A partition's pieces take the last slots of the nearest partition before it that has any. Numbers of a run of slots
    count down: the last slot has the least.
    """
    of_pieces, of_slots, free, number = defaultdict(list), defaultdict(list), [], 0
    for p in sorted({*pieces, *slots}):
        at, many = 0, pieces.get(p, 0)
        while at < many and free:
            q, left = free.pop()
            take = min(many - at, left)
            of_pieces[p].append((at, at + take, number))
            of_slots[q].append((left - take, left, number))
            at, number = at + take, number + take
            if left > take:
                free.append((q, left - take))
        if slots.get(p):
            free.append((p, slots[p]))
    return dict(of_pieces), dict(of_slots)


def added_tokens(tokenizer) -> dict[str, int]:
    """Strings and ids of a tokenizer's added tokens; those that are found in another way than as they are written raise."""
    added = tokenizer.get_added_tokens_decoder()
    for t in added.values():
        if t.single_word or t.lstrip or t.rstrip:
            raise ValueError(f"added token with conditions: {t}")
    return {t.content: i for i, t in added.items()}


def byte_letters() -> dict[int, int]:
    """The letter that byte-level tokenizers write for each byte: printable Latin-1 as it is, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


class Words(bpe.Ranks):
    """The tokenizer of a json file; its model encodes each distinct pre-token of a slice once."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = added_tokens(self.tokenizer)
        self.known: dict[bytes, bytes] = {}
        self.letters = byte_letters()
        # The array form of the pattern stands for the file's own pre-tokenizer; another one is refused.
        sample = "It's 12  o'clock\n\n (né漢)  'tis\t!"
        own = [x[0] for x in self.tokenizer.pre_tokenizer.pre_tokenize_str(sample)]
        buf, off = kit.utf8(pa.array([sample]))
        start = bpe.pretoken_starts(buf, off)[0]
        if self.tokenizer.normalizer is not None or own != [self._letters(buf[a:b].tobytes()) for a, b in zip(start, np.append(start[1:], len(buf)))]:
            raise ValueError(f"{path} does not split texts as {pattern} does")

    def _letters(self, piece: bytes) -> str:
        return piece.decode("latin-1").translate(self.letters)

    def encode_pieces(self, pieces):
        tokenize, shown = self.tokenizer.model.tokenize, self._letters(b"".join(pieces))  # one letter a byte
        ends = np.cumsum([len(p) for p in pieces]).tolist()
        return [[t.id for t in tokenize(shown[a:b])] for a, b in zip([0, *ends], ends)]


def encode_rows(own: bpe.Ranks, column: pa.Array, added: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows end to end, and each row's first; added tokens are cut out of the texts before these are encoded."""
    buf, off = kit.utf8(column)
    found = re.compile("|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)).encode()) if added else None
    hits = [(m.start(), m.end(), added[m.group().decode()]) for m in found.finditer(buf.tobytes())] if found else []
    if hits:  # a match that two rows make together is none; rows are then searched on their own
        row = np.searchsorted(off, [a for a, _, _ in hits], side="right") - 1
        if any(b > off[r + 1] for (_, b, _), r in zip(hits, row)):
            raw = buf.tobytes()
            hits = [(a + m.start(), a + m.end(), added[m.group().decode()]) for a, b in zip(off[:-1].tolist(), off[1:].tolist()) for m in found.finditer(raw[a:b])]
    if not hits:
        return own.encode_rows(buf, off)
    # Each text between tokens is a row of its own; a token is an empty one, whose id is put in afterwards.
    cuts = np.array([x for a, b, _ in hits for x in (a, b)], np.int64)
    edges = np.sort(np.concatenate([off, cuts]), kind="stable")
    token = np.array([a for a, _, _ in hits], np.int64)
    keep = np.ones(len(buf), bool)
    for a, b, _ in hits:
        keep[a:b] = False
    kept = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    ids, first = own.encode_rows(buf[keep], kept[edges])
    # The first edge at or after a token's start: what was encoded before it ends there.
    place = first[np.searchsorted(edges, token, side="left")]
    out = np.insert(ids.astype(np.int64), place, [i for _, _, i in hits])
    ends = first[np.searchsorted(edges, off, side="left")]
    return out, ends + np.searchsorted(token, off, side="left")


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, carry: bool = False) -> DataFrame:
    """One row per piece, ids by the tokenizer file at `path`. carry: also `ids` of the piece."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    pattern = public_tokenizers.PATTERN

    def run(batches):
        own = Words(path, pattern)
        for part in kit.slices(batches):
            ids, first = encode_rows(own, part.column(1), own.added)
            doc, nth, start, length, crc, raw = [], [], [], [], [], []
            for d, a, b in zip(part.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                own_ids = np.append(ids[a:b], END).astype("<u4")
                n, data = len(own_ids), own_ids.tobytes()
                head = n % capacity or capacity
                at = 0
                for k in range((n - head) // capacity + 1):
                    stop = head + k * capacity
                    doc.append(d), nth.append(k), start.append(at), length.append(stop - at), crc.append(zlib.crc32(data[4 * at : 4 * stop]))
                    if carry:
                        raw.append(own_ids[at:stop].tolist())
                    at = stop
            cols = [pa.array(doc, pa.int64()), pa.array(nth, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(raw, pa.list_(pa.int64()))] if carry else []), ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if carry else []))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if carry else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def checkpoint_dir(spark) -> None:
    """Makes sure that checkpoints have a folder: the one of spark.checkpoint.dir. Only in local mode, where that may be
    unset, it is a temporary one of this machine."""
    if not spark.sparkContext.getCheckpointDir():
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            own = tempfile.mkdtemp()
        spark.sparkContext.setCheckpointDir(own)


def saved(df: DataFrame) -> DataFrame:
    """The rows, written as a table to the shared checkpoint folder and read again: lineage ends, lost executors lose
    nothing, and the planner knows the true size (a checkpoint keeps its estimate, which grows with each join)."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the files of a saved table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_MATCHED, _PIECE, _SLOT = 0, 1, 2
_SWEPT = "state int, part int, nth long, id long, length int, seq long, slot int, used int"


def _sweep(batches):
    """One sorted partition of slots (kind 0) and pieces (kind 1): who takes what, and what is left over of both."""
    t = pa.Table.from_batches(list(batches))
    if not t.num_rows:
        return
    size, kind, ident, slot, used = (t[k].to_numpy() for k in ("size", "kind", "id", "slot", "used"))
    free: list[int] = []
    takes, taken, alone = [], [], []
    for i, k in enumerate(kind.tolist()):
        if not k:
            free.append(i)
        elif free:
            takes.append(i)
            taken.append(free.pop())
        else:
            alone.append(i)
    part = TaskContext.get().partitionId()
    takes, taken, alone, free = (np.array(x, np.int64) for x in (takes, taken, alone, free))
    for state, p, s in ((_MATCHED, takes, taken), (_PIECE, alone, None), (_SLOT, None, free)):
        n = len(p if p is not None else s)
        if n:
            own = [pa.array(np.full(n, state, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(n))]
            own += [pa.array(ident[p]), pa.array(size[p], pa.int32())] if p is not None else [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())]
            own += [pa.array(ident[s]), pa.array(slot[s], pa.int32()), pa.array(used[s], pa.int32())] if s is not None else [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())]
            yield pa.RecordBatch.from_arrays(own, ["state", "part", "nth", "id", "length", "seq", "slot", "used"])


def _numbered(left: DataFrame, runs: tuple[dict, dict]) -> DataFrame:
    """Left-over rows with the number by which a piece and a slot meet; null: none."""

    def run(batches):
        for b in batches:
            state, part, nth = (b.column(k).to_numpy() for k in ("state", "part", "nth"))
            number = np.full(len(nth), -1, np.int64)
            for kind, of in ((_PIECE, runs[0]), (_SLOT, runs[1])):
                for p in np.unique(part[state == kind]).tolist():
                    rows = np.flatnonzero((state == kind) & (part == p))
                    for first, end, base in of.get(p, ()):
                        at = rows[(nth[rows] >= first) & (nth[rows] < end)]
                        number[at] = base + (nth[at] - first if kind == _PIECE else end - 1 - nth[at])
            yield b.append_column("number", pa.array(number, mask=number < 0))

    return left.mapInArrow(run, _SWEPT + ", number long")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces of known length (1 to capacity)."""
    spark = cut.sparkSession
    rows = saved(cut.withColumn("_id", F.monotonically_increasing_id()))
    left = rows.select(F.col("_id").alias("id"), F.col("length").cast("int").alias("length"))
    gaps, placed, opened = spark.createDataFrame([], "seq long, size int, used int"), [], 0
    old: list[DataFrame] = []
    while True:
        found = left.groupBy("length").count().select(F.lit(1).alias("kind"), "length", "count").union(gaps.groupBy("size").count().select(F.lit(0), "size", "count")).collect()
        lengths, sizes = ({r.length: r[2] for r in found if r.kind == k} for k in (1, 0))
        if not lengths:
            break
        longest, largest = max(lengths), max(sizes, default=0)
        stuck = {n: m for n, m in lengths.items() if n > largest}
        new = needed(stuck, capacity) if stuck else 0
        if not placed and new > 64:
            new = -(-new // 2)
        if new:
            gaps = gaps.union(spark.range(opened, opened + new).select(F.col("id").alias("seq"), F.lit(capacity), F.lit(0)))
            sizes[capacity] = sizes.get(capacity, 0) + new
            opened += new
        n_pieces, n_gaps = sum(lengths.values()), sum(sizes.values())
        most = max(1, -(-2 * n_pieces // n_gaps))
        many = F.greatest(F.lit(1), F.least(F.floor(F.col("size") / longest), F.lit(most))).cast("int")
        several = most > 1 and max(sizes) >= 2 * longest
        slots = gaps.select("seq", "size", "used", many.alias("many"), (F.explode(F.sequence(F.lit(1), many)) if several else F.lit(1)).alias("slot"))
        slots = slots.select(F.floor(F.col("size") / F.col("many")).cast("int").alias("size"), F.lit(0).alias("kind"), F.col("seq").alias("id"), "slot", "used")
        items = slots.union(left.select("length", F.lit(1), "id", F.lit(0), F.lit(0)))
        order = [F.desc("size"), F.asc("kind"), F.xxhash64("id", "slot")]
        n_rows = n_pieces + most * n_gaps
        parts = max(2, math.ceil(n_rows / min(MOST_SWEEP_ROWS, max(SWEEP_ROWS, n_rows // SWEEPS))))
        swept = saved(items.repartitionByRange(parts, *order).sortWithinPartitions(*order, "id", "slot").mapInArrow(_sweep, _SWEPT))
        over = swept.where(f"state <> {_MATCHED}").groupBy("state", "part").count().collect()
        runs = bridges(*({r.part: r["count"] for r in over if r.state == k} for k in (_PIECE, _SLOT)))
        matched = swept.where(f"state = {_MATCHED}").select("id", "length", "seq", "slot", "used")
        alone = swept.where(f"state = {_PIECE}")
        if runs[0]:
            numbered = _numbered(swept.where(f"state <> {_MATCHED}"), runs)
            met = numbered.where(f"state = {_PIECE} AND number IS NOT NULL").select("number", "id", "length")
            matched = matched.union(met.join(numbered.where(f"state = {_SLOT} AND number IS NOT NULL").select("number", "seq", "slot", "used"), "number").drop("number"))
            alone = numbered.where(f"state = {_PIECE} AND number IS NULL")
        before = F.sum("length").over(Window.partitionBy("seq").orderBy("slot")) - F.col("length") if several else F.lit(0)
        got = saved(matched.select("id", "length", "seq", (F.col("used") + before).cast("long").alias("offset")))
        placed.append(got)
        more = got.groupBy("seq").agg(F.sum("length").cast("int").alias("more"))
        shrunk = gaps.join(more, "seq", "left").select("seq", (F.col("size") - F.coalesce("more", F.lit(0))).alias("size"), (F.col("used") + F.coalesce("more", F.lit(0))).alias("used"))
        gaps = saved(shrunk.where(F.col("size") >= min(lengths)))
        left = alone.select("id", "length")
        for x in old:
            drop(x)
        old = [swept]
    names = cut.columns
    if not placed:
        return rows.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    places = functools.reduce(DataFrame.union, placed).select(F.col("id").alias("_id"), F.col("seq").alias("sequence_id"), "offset")
    return rows.join(places, "_id").select(*names, "sequence_id", "offset")


def best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(pieces(kit.table(spark, sf_dir, "documents")))
