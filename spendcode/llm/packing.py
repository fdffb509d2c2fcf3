"""Best-fit packing of tokenised documents by swap-based local search.

Documents are tokenised (byte-level BPE, id 0 at the end), longer ones than a sequence are cut into
full pieces behind a first, shorter one, and the pieces packed into as few sequences as possible.

* Pieces are dealt at random to shards of about ``SHARD`` pieces; a task packs one shard.
* In a shard best-fit decreasing gives a start.  Then any two underfull bins exchange: the fuller one takes
  a piece, or one or two pieces for one or two smaller ones, from the other, as many tokens as its gap
  allows.  Each step adds to the sum of squared fills, so gaps gather in few bins until these are empty
  and are dropped.  The search ends when no such step is left or a lower bound is reached.
  Pieces, and pairs within a bin, are found by length, so a step looks at lengths and not at bins; no
  piece, pair or bin is left out.
* Bins filled below ``LOOSE`` are opened again and their pieces packed with those of other shards, in
  rounds that mostly shrink by three orders of magnitude, until one shard holds what is left.
* Where the pieces cannot fill bins (each shard is a fair sample, so the next deal finds the same), a
  round neither halves the loose pieces nor frees ``FREED`` of the bins.  Then all bins are final but
  the emptiest, of at most ``ON`` of the round's pieces: a shard leaves one bin at most half full, and
  these meet in the next round.  So every round shrinks and the rounds end.

Edge cases: a null text is an empty document (one token); repeated rows are packed as often as they
occur; a null id is a value like any other; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendcode.llm.common import python_tasks, stored
from spendcode.llm.tokens import byte_encoder

CAPACITY = 2048
SHARD = 20_000
LOOSE = 0.95
FREED = 0.01
ON = 1 / 8
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, nr bigint"


def pieces_of(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """``(piece, start, length, crc32)`` of a document's ids (little-endian 32 bits each)."""
    n = len(ids) // 4
    k = -(-n // capacity)
    view, out, start = memoryview(ids), [], 0
    for piece in range(k):
        length = n - capacity * (k - 1) if piece == 0 else capacity
        out.append((piece, start, length, zlib.crc32(view[4 * start:4 * (start + length)])))
        start += length
    return out


def tokenised_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                     capacity: int = CAPACITY) -> DataFrame:
    """One row a piece; ``nr`` numbers the rows (for dealing, so repeated rows do not meet)."""
    python_tasks(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(tokenizer)
        nr = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows: list[tuple] = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                for p in pieces_of(ids + b"\0\0\0\0", capacity):
                    rows.append((doc, *p, nr))
                    nr += 1
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "nr"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, _PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """Bin of each piece by best-fit decreasing, and the fill of each bin."""
    bins = np.empty(len(lengths), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is free in them
    some = np.zeros(capacity + 1, dtype=bool)
    fills: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = n + int(some[n:].argmax())
        if some[at]:
            b = free[at].pop()
            some[at] = bool(free[at])
        else:
            b = len(fills)
            fills.append(0)
        fills[b] += n
        bins[i] = b
        left = capacity - fills[b]
        free[left].append(b)
        some[left] = left > 0
    return bins, fills


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound on bins: for each size ``a``, pieces over half a bin stand alone, what they leave may
    take pieces of ``a`` at least, and those over ``capacity - a`` leave nothing for them."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    many = np.concatenate([[0], np.cumsum(count)])                       # pieces shorter than i
    total = np.concatenate([[0], np.cumsum(count * np.arange(capacity + 1))])
    half, a = capacity // 2, np.arange(capacity // 2 + 1)
    big = many[-1] - many[capacity - a + 1]
    middle, middle_sum = many[capacity - a + 1] - many[half + 1], total[capacity - a + 1] - total[half + 1]
    small_sum = total[half + 1] - total[a]
    rest = np.maximum(0, small_sum - (middle * capacity - middle_sum))
    return int((big + middle - (-rest // capacity)).max())


class _Pool:
    """Underfull bins, and which of them hold a piece, or two pieces together, of a length."""

    def __init__(self, lengths: np.ndarray, bins: np.ndarray, fills: np.ndarray, capacity: int):
        self.lengths, self.fills, self.capacity = lengths, fills, capacity
        self.held: list[dict[int, list[int]]] = [{} for _ in fills]   # bin -> length -> pieces
        for i, (b, n) in enumerate(zip(bins.tolist(), lengths.tolist())):
            self.held[b].setdefault(n, []).append(i)
        self.one: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.two: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.has = np.zeros((2, capacity + 1), dtype=np.int64)
        for b in range(len(fills)):
            self.show(b)

    def sums(self, b: int) -> tuple[list[int], list[int]]:
        """Lengths of a bin's pieces, and of its pairs of pieces."""
        own = sorted(self.held[b])
        pairs = {x + y for k, x in enumerate(own) for y in own[k + 1:]} | {2 * x for x in own if len(self.held[b][x]) > 1}
        return own, list(pairs)

    def show(self, b: int) -> None:
        if 0 < self.fills[b] < self.capacity:
            for kind, (index, found) in enumerate(zip((self.one, self.two), self.sums(b))):
                for n in found:
                    index[n].add(b)
                self.has[kind, found] += 1

    def hide(self, b: int) -> None:
        if 0 < self.fills[b] < self.capacity:
            for kind, (index, found) in enumerate(zip((self.one, self.two), self.sums(b))):
                for n in found:
                    index[n].discard(b)
                self.has[kind, found] -= 1

    def parts(self, b: int, kind: int, n: int) -> list[int]:
        """Lengths of one piece, or of the two pieces, that make ``n`` in a bin."""
        if n == 0:
            return []
        if kind == 0:
            return [n]
        return next([x, n - x] for x in self.held[b] if n - x in self.held[b] and (2 * x != n or len(self.held[b][x]) > 1))

    def carry(self, a: int, b: int, sizes: list[int]) -> None:
        """Pieces of these lengths go from bin ``a`` to ``b``."""
        for n in sizes:
            piece = self.held[a][n].pop()
            if not self.held[a][n]:
                del self.held[a][n]
            self.held[b].setdefault(n, []).append(piece)
            self.fills[a] -= n
            self.fills[b] += n


def _step(pool: _Pool, a: int) -> bool:
    """The exchange that brings most tokens into bin ``a``, which must be hidden from the pool; whether there was one."""
    gap, fill = pool.capacity - int(pool.fills[a]), int(pool.fills[a])
    own, pairs = pool.sums(a)
    back = np.array([0, *own, *pairs])
    back_kind = [0] * (1 + len(own)) + [1] * len(pairs)
    room = np.minimum(back + gap, pool.capacity)
    places = np.arange(pool.capacity + 1)
    options = []
    for kind in (0, 1):
        largest = np.maximum.accumulate(np.where(pool.has[kind] > 0, places, 0))  # largest at hand up to each length
        gain = largest[room] - back
        options += [(int(g), kind, k) for k, g in enumerate(gain.tolist()) if g > 0]
    for d, kind, k in sorted(options, reverse=True):
        # the sum of squares grows if tokens go to the fuller bin, or more than what it is fuller by
        others = (pool.one, pool.two)[kind][int(back[k]) + d]
        b = min(others, key=lambda x: (pool.fills[x], x))
        if d > pool.fills[b] - fill:
            pool.hide(b)
            out, returned = pool.parts(b, kind, int(back[k]) + d), pool.parts(a, back_kind[k], int(back[k]))
            pool.carry(b, a, out)
            pool.carry(a, b, returned)
            pool.show(b)
            return True
    return False


def local_search(lengths: np.ndarray, bins: np.ndarray, fills: np.ndarray, capacity: int) -> int:
    """Exchange between underfull bins, in place, until none is left that helps; an emptied bin has fill 0.

    Returns the number of steps."""
    least, steps = least_bins(lengths, capacity), 0
    if np.count_nonzero(fills) <= least:
        return 0
    pool = _Pool(lengths, bins, fills, capacity)
    moved = True
    while moved and np.count_nonzero(fills) > least:
        moved = False
        for a in np.lexsort((np.arange(len(fills)), -fills)).tolist():  # fullest first
            if not 0 < fills[a] < capacity:
                continue
            pool.hide(a)
            while fills[a] < capacity and _step(pool, a):
                moved, steps = True, steps + 1
            pool.show(a)
    for b, held in enumerate(pool.held):
        for pieces in held.values():
            bins[pieces] = b
    return steps


def pack_shard(lengths: np.ndarray, capacity: int) -> np.ndarray:
    bins, fills = best_fit(lengths, capacity)
    local_search(lengths, bins, np.array(fills, dtype=np.int64), capacity)
    return bins


def _shard_packer(capacity: int, base: int):
    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("nr", ignore_index=True)
        group["sequence_id"] = pack_shard(group["length"].to_numpy(), capacity)
        group = group.sort_values(["sequence_id", "doc_id", "piece", "nr"], ignore_index=True)
        by = group.groupby("sequence_id")["length"]
        group["offset"] = by.cumsum() - group["length"]
        group["fill"] = by.transform("sum")
        group["sequence_id"] += (base + int(key[0])) << 20
        return group.drop(columns="shard")
    return pack


def _open_below(levels: list[tuple[int, int, int]], n: int, opened: int, loose: float) -> float:
    """Fill below which the bins of a round over ``n`` pieces of ``opened`` bins are opened again.

    ``levels`` has, for each fill, the number of pieces in such bins and of the bins.
    """
    left = sum(pieces for fill, pieces, _ in levels if fill < loose)
    freed = opened - sum(bins for _, _, bins in levels)
    if left <= n / 2 or freed >= FREED * opened:
        return loose
    on = 0
    for fill, pieces, _ in sorted(levels):
        on += pieces
        if on > ON * n:
            return fill
    return loose


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with doc_id, piece, length and the number nr) plus sequence_id and offset."""
    spark = pieces.sparkSession
    python_tasks(spark)
    left, done, turn, base = pieces, None, 0, 0
    n = opened = left.count()
    schema = f"{_PIECES}, sequence_id bigint, offset bigint, fill bigint"
    while True:
        shards = max(1, math.ceil(n / SHARD))
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("nr", F.lit(turn)), F.lit(shards)))
        packed = stored(dealt.groupBy("shard").applyInPandas(_shard_packer(capacity, base), schema), "packed")
        levels = [] if shards == 1 else [tuple(r) for r in packed.groupBy("fill").agg(
            F.count(F.lit(1)), F.count_if(F.col("offset") == 0)).collect()]  # at most a row for each fill
        below = _open_below(levels, n, opened, LOOSE * capacity)
        n, opened = (sum(level[i] for level in levels if level[0] < below) for i in (1, 2))
        final = packed.where(F.col("fill") >= below) if n else packed
        done = final if done is None else done.unionByName(final)
        if not n:
            return done.drop("fill", "nr")
        left = packed.where(F.col("fill") < below).select(*[f.split()[0] for f in _PIECES.split(", ")])
        turn, base = turn + 1, base + shards


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stored(tokenised_pieces(docs, tokenizer, id_col, text_col, capacity), "pieces")
    return pack_pieces(pieces, capacity).withColumnRenamed("doc_id", id_col)
