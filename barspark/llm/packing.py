"""Best-fit packing of token sequences, improved by swaps between underfull bins.

Documents are encoded once; those longer than a sequence are cut into whole sequences, and a shorter first piece. Full
pieces are sequences of their own. The others are dealt to groups of about ``GROUP`` pieces by a hash, and each group
is packed by itself: best fit by decreasing length, then a local search. It takes the least-filled bin and, as long
as the sum of squared fills grows, moves a piece to a fuller bin, exchanges a piece for a shorter one of a fuller bin,
one for two that are shorter together, or two for one that is shorter, until the bin is empty or nothing helps. A
group wastes about one bin in ten thousand, so groups need no second round.

Null and empty texts consist of the end id. Repeated rows are packed each for itself, a null id is like any other.
An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import stage
from .common import map_arrow
from .tokens import CACHED, ID, encoder, text_parts

CAPACITY = 2048
GROUP = 16_384
#: Bins that the local search gives up on in a row before it ends, and steps for one bin.
PATIENCE, STEPS = 48, 64


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece: longest first, into the bin with the least room that holds it."""
    bins = np.empty(len(lengths), np.int64)
    room: dict[int, list[int]] = defaultdict(list)
    rooms = count = 0  # bit r of rooms: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                rooms &= ~(1 << left)
        else:
            left, at = capacity, count
            count += 1
        bins[i] = at
        left -= size
        if left:
            room[left].append(at)
            rooms |= 1 << left
    return bins


class Swaps:
    """Local search over the bins; ``lengths`` and ``bins`` by piece."""

    def __init__(self, lengths: np.ndarray, bins: np.ndarray, capacity: int) -> None:
        self.lengths, self.bins, self.capacity = lengths.astype(np.int64), bins, capacity
        self.fill = np.bincount(bins, weights=lengths).astype(np.int64)
        self.inside: dict[int, set[int]] = defaultdict(set)
        for i, b in enumerate(bins.tolist()):
            self.inside[b].add(i)

    def _put(self, piece: int, to: int) -> None:
        b, size = int(self.bins[piece]), int(self.lengths[piece])
        self.inside[b].discard(piece)
        self.inside[to].add(piece)
        self.fill[b] -= size
        self.fill[to] += size
        self.bins[piece] = to

    def _gain(self, bin: int) -> bool:
        """One exchange that takes most from ``bin`` and fills a fuller bin; whether there was one."""
        own = sorted(self.inside[bin], key=lambda i: -self.lengths[i])
        # bins that may receive: fuller, and not full
        open_bins = (self.fill >= self.fill[bin]) & (self.fill < self.capacity)
        open_bins[bin] = False
        slack = np.where(open_bins, self.capacity - self.fill, -1)
        if slack.max() <= 0:
            return False
        for x in own:  # move
            fits = np.where(slack >= self.lengths[x], slack, self.capacity + 1)
            to = int(fits.argmin())
            if fits[to] <= self.capacity:
                self._put(x, to)
                return True
        there = np.flatnonzero(slack[self.bins] > 0)
        if not len(there):
            return False
        sizes, most = self.lengths[there], slack[self.bins[there]]

        def best(size: int) -> int:
            more = size - sizes
            at = int(np.where((more > 0) & (more <= most), more, 0).argmax())
            return int(there[at]) if 0 < size - sizes[at] <= most[at] else -1

        for x in own:  # one for one
            y = best(int(self.lengths[x]))
            if y >= 0:
                to = int(self.bins[y])
                self._put(y, bin)
                self._put(x, to)
                return True
        for k, x1 in enumerate(own):  # two for one
            for x2 in own[k + 1 : k + 9]:
                y = best(int(self.lengths[x1] + self.lengths[x2]))
                if y >= 0:
                    to = int(self.bins[y])
                    self._put(y, bin)
                    self._put(x1, to)
                    self._put(x2, to)
                    return True
        for x in own:  # one for two
            size = int(self.lengths[x])
            for b in np.flatnonzero(slack > 0)[:512].tolist():
                inner = sorted(self.inside[b], key=lambda i: self.lengths[i])[:8]
                for k, y1 in enumerate(inner):
                    for y2 in inner[k + 1 :]:
                        if 0 < size - int(self.lengths[y1] + self.lengths[y2]) <= slack[b]:
                            self._put(y1, bin)
                            self._put(y2, bin)
                            self._put(x, b)
                            return True
        return False

    def run(self, patience: int = PATIENCE, steps: int = STEPS) -> np.ndarray:
        failed, given_up = 0, np.zeros(len(self.fill), bool)
        while failed < patience:
            if int(-(-self.fill.sum() // self.capacity)) >= int((self.fill > 0).sum()):
                break  # as few as there can be
            open_bins = (self.fill > 0) & (self.fill < self.capacity) & ~given_up
            if not open_bins.any():
                break
            bin = int(np.where(open_bins, self.fill, self.capacity + 1).argmin())
            for _ in range(steps):
                if not self.fill[bin] or not self._gain(bin):
                    break
                given_up[:] = False  # other bins have changed: those given up may be tried again
            if self.fill[bin]:
                given_up[bin] = True
                failed += 1
            else:
                failed = 0
        return self.bins


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each piece, numbered from 0 without gaps."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    bins = Swaps(lengths, best_fit(lengths, capacity), capacity).run()
    return np.unique(bins, return_inverse=True)[1].astype(np.int64)


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces_of(
    docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text", end_id: int = 0,
    capacity: int = CAPACITY, with_ids: bool = False, cached: int = CACHED,
) -> DataFrame:
    """Encode whole texts, append ``end_id``, and cut: only the first piece may be shorter than ``capacity``.

    ``with_ids`` adds ``ids``, the ids of the piece as little-endian unsigned 32-bit integers. ``cached`` bounds the
    chunks that a worker remembers.
    """
    rows = docs.select(F.col(f"`{id}`").cast("bigint").alias("d"), F.col(f"`{text}`").cast("string").alias("t"))
    tail, width = np.array([end_id], ID).tobytes(), ID.itemsize

    def run(batch: pa.RecordBatch):
        code = encoder(vocabulary, cached)
        for some in text_parts(batch, 1, code.slice_bytes):
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for d, data in zip(some.column(0).to_pylist(), code.encode(some.column(1))):
                data += tail
                n = len(data) // width
                begin, end, piece = 0, n % capacity or capacity, 0
                while begin < n:
                    own = data[begin * width : end * width]
                    for k, v in zip(out, (d, piece, begin, end - begin, zlib.crc32(own), own if with_ids else None)):
                        out[k].append(v)
                    begin, end, piece = end, end + capacity, piece + 1
            yield out

    return map_arrow(rows, run, PIECES + (", ids binary" if with_ids else ""))


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to staged pieces (read more than once); other columns stay."""
    full = pieces.where(F.col("length") == capacity)
    short = pieces.where(F.col("length") < capacity)
    groups = -(-short.count() // group) or 1
    alone = full.withColumn("sequence_id", -F.monotonically_increasing_id() - 1).withColumn(
        "offset", F.lit(0).cast("bigint")
    )

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.drop_columns("_group").sort_by(
            [("length", "descending"), ("doc_id", "ascending"), ("ids_crc32", "ascending")]
        )
        lengths = table["length"].to_numpy()
        bins = pack_lengths(lengths, capacity)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.concatenate(([True], np.diff(bins[order]) > 0))
        offsets = np.empty(len(bins), np.int64)
        offsets[order] = before - before[first][np.cumsum(first) - 1]
        table = table.append_column("sequence_id", pa.array((key[0].as_py() << 40) + bins, pa.int64()))
        return table.append_column("offset", pa.array(offsets, pa.int64()))

    dealt = short.withColumn("_group", F.pmod(F.xxhash64("doc_id", "ids_crc32"), F.lit(groups)))
    packed = dealt.groupBy("_group").applyInArrow(run, alone.schema)
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, vocabulary: str, with_ids: bool = False, cached: int = CACHED) -> DataFrame:
    return pack(stage(pieces_of(docs, vocabulary, with_ids=with_ids, cached=cached), "pieces"))
