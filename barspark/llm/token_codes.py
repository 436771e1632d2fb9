"""Token-id files of directly addressable codes.

An id is split into chunks of ``width`` bits, the lowest first. Level 0 holds the lowest chunk of every id, and a
bitmap that says which ids go on; level 1 holds the next chunk of those, and so on. A rank directory counts the set
bits before each block of ``BLOCK`` bits, so the place of an id on the next level is one look-up and one count
within a block: any token is read without decoding others.

Layout of a segment (little-endian): ``DAC1``, width u8, levels u8, u16 0, number of ids u64, the entries of each
level u64; then by level the chunks (u8 or u16 each), and except on the last level the bitmap and the directory (u32).

``write`` sorts documents by id, cuts them into segments of about ``SEGMENT`` tokens, and writes these as the binary
rows of Parquet files, through Spark's own committer: a lost executor or a second attempt leaves no half-written
file, and any file system that Spark writes to will do. ``read`` opens the segments and takes each document's ids
from them by their place.

Null and empty texts have only the end id. A null document id sorts first. Rows that repeat an id are written one
after the other, in the order of their texts. An empty table gives no segments and no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans import stage_path
from .common import map_arrow
from .tokens import ID, encoder, text_parts

MAGIC = b"DAC1"
BLOCK = 512
SEGMENT = 1 << 20


def _bits(flags: np.ndarray) -> tuple[bytes, bytes]:
    """A bitmap and the set bits before each of its blocks."""
    padded = np.zeros(-(-len(flags) // BLOCK) * BLOCK, bool)
    padded[: len(flags)] = flags
    counts = padded.reshape(-1, BLOCK).sum(axis=1, dtype=np.uint32)
    before = np.concatenate(([0], np.cumsum(counts)[:-1])).astype("<u4") if len(counts) else np.zeros(0, "<u4")
    return np.packbits(padded, bitorder="little").tobytes(), before.tobytes()


def pack(ids: np.ndarray, width: int = 8) -> bytes:
    """A segment of the given unsigned ids."""
    if width not in (8, 16):
        raise ValueError("width is 8 or 16")
    kind, rest, counts, parts = np.dtype(f"<u{width // 8}"), ids.astype(np.uint64), [], []
    while True:
        chunk = (rest & np.uint64((1 << width) - 1)).astype(kind)
        rest = rest >> np.uint64(width)
        counts.append(len(chunk))
        parts.append(chunk.tobytes())
        on = rest > 0
        if not on.any():
            break
        parts += _bits(on)
        rest = rest[on]
    head = MAGIC + struct.pack("<BBHQ", width, len(counts), 0, len(ids)) + struct.pack(f"<{len(counts)}Q", *counts)
    return head + b"".join(parts)


class Codes:
    """Random access to the ids of a segment."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.width, levels, _, self.n = struct.unpack_from("<BBHQ", data, 4)
        counts = struct.unpack_from(f"<{levels}Q", data, 16)
        at = 16 + 8 * levels
        kind = np.dtype(f"<u{self.width // 8}")
        self.levels = []
        for level, count in enumerate(counts):
            chunks = np.frombuffer(data, kind, count, at)
            at += count * kind.itemsize
            if level == levels - 1:
                self.levels.append((chunks, None, None))
                continue
            blocks = -(-count // BLOCK)
            bitmap = np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at)
            at += blocks * BLOCK // 8
            before = np.frombuffer(data, "<u4", blocks, at)
            at += 4 * blocks
            self.levels.append((chunks, bitmap, before))

    def __len__(self) -> int:
        return self.n

    def _rank(self, level: int, place: int) -> int:
        """Set bits before ``place``."""
        _, bitmap, before = self.levels[level]
        if place >= 8 * len(bitmap):
            return len(self.levels[level + 1][0])
        block, inside = divmod(place, BLOCK)
        bits = np.unpackbits(bitmap[block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return int(before[block]) + int(bits[:inside].sum())

    def __getitem__(self, place: int) -> int:
        if not 0 <= place < self.n:
            raise IndexError(place)
        value, shift = 0, 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[place]) << shift
            if bitmap is None or not bitmap[place >> 3] >> (place & 7) & 1:
                return value
            place, shift = self._rank(level, place), shift + self.width
        return value

    def ids(self, begin: int, end: int, level: int = 0) -> np.ndarray:
        """The ids from ``begin`` to ``end``, reading only their part of each level."""
        chunks, bitmap, _ = self.levels[level]
        values = chunks[begin:end].astype(np.uint32)
        if bitmap is None or end <= begin:
            return values
        first = begin // 8
        flags = np.unpackbits(bitmap[first : -(-end // 8)], bitorder="little")[begin - 8 * first :][: end - begin]
        on = np.flatnonzero(flags)
        if len(on):
            rank = self._rank(level, begin)
            values[on] |= self.ids(rank, rank + len(on), level + 1) << np.uint32(self.width)
        return values


SEGMENTS = "part int, seq int, before bigint, n_tokens bigint, docs array<bigint>, ends array<bigint>, data binary"


def write(
    docs: DataFrame, path: str, vocabulary: str, id: str = "doc_id", text: str = "text", end_id: int = 2,
    width: int = 8, segment: int = SEGMENT,
) -> None:
    """Encode whole texts, append ``end_id`` to each, and write the segments in ascending order of ``id``."""
    rows = docs.select(F.col(f"`{id}`").cast("bigint").alias("d"), F.col(f"`{text}`").cast("string").alias("t"))
    ranged = rows.repartitionByRange("d").sortWithinPartitions("d", "t")
    tail = np.array([end_id], ID).tobytes()

    def state() -> dict:
        return {"seq": 0, "before": 0}

    def run(batches):
        code, at = encoder(vocabulary), state()
        part = TaskContext.get().partitionId()
        ids: list[bytes] = []
        docs_in: list[int | None] = []
        ends: list[int] = []
        size = 0

        def flush():
            data = np.frombuffer(b"".join(ids), ID)
            out = {
                "part": [part], "seq": [at["seq"]], "before": [at["before"]], "n_tokens": [len(data)],
                "docs": [list(docs_in)], "ends": [list(ends)], "data": [pack(data, width)],
            }
            at["seq"] += 1
            at["before"] += len(data)
            return out

        for some in (p for batch in batches for p in text_parts(batch, 1, code.slice_bytes)):
            for d, own in zip(some.column(0).to_pylist(), code.encode(some.column(1))):
                own += tail
                size += len(own) // ID.itemsize
                ids.append(own)
                docs_in.append(d)
                ends.append(size)
                if size >= segment:
                    yield flush()
                    ids, docs_in, ends, size = [], [], [], 0
        if ids:
            yield flush()

    schema = pa.schema([
        ("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()),
        ("docs", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("data", pa.binary()),
    ])

    def emit(batches):
        for columns in run(batches):
            yield pa.RecordBatch.from_pydict(columns, schema=schema)

    ranged.mapInArrow(emit, SEGMENTS).write.parquet(path)


def read(segments: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32`` from the files."""
    # one row for each part, of which there are as many as range partitions
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))

    def run(batch: pa.RecordBatch):
        for r in batch.to_pylist():
            codes, begin = Codes(r["data"]), 0
            places, counts, sums = [], [], []
            for end in r["ends"]:
                sums.append(zlib.crc32(codes.ids(begin, end).astype(ID).tobytes()))
                places.append(r["part_start"] + r["before"] + begin)
                counts.append(end - begin)
                begin = end
            yield {"doc_id": r["docs"], "start": places, "n_tokens": counts, "ids_crc32": sums}

    wanted = segments.join(F.broadcast(starts), "part").select("part_start", "before", "docs", "ends", "data")
    return map_arrow(wanted, run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokens_at(segments: DataFrame, part: int, seq: int, places: list[int]) -> list[int]:
    """Single tokens of one segment, by their place in it."""
    row = segments.where((F.col("part") == part) & (F.col("seq") == seq)).select("data").first()
    codes = Codes(row.data)
    return [codes[p] for p in places]


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write the documents to the shared folder and read them back."""
    path = stage_path(docs.sparkSession, "token-codes")
    write(docs, path, vocabulary)
    return read(docs.sparkSession.read.schema(SEGMENTS).parquet(path))
