"""Repeated substrings by content-defined chunks.

A gear rolling hash over the last ``WINDOW`` bytes of the text ends a chunk where its top bits are zero, ``LEAST`` bytes after the
last end at the earliest and ``MOST`` at the latest, so an insertion moves only the ends near it. Chunks are counted by a
rolling hash first; those that occur once go no further. The others get a BLAKE2 digest, the first place of each (by
document id, then place) keeps it, and the later ones are repeats.

Consecutive repeats of a text whose first places are consecutive too are one run. It grows byte by byte on both sides for
as long as the text agrees with what surrounds the first place, by ``REACH`` bytes a side at most; what lies beyond is for
the chunks there. A run of ``PASSAGE`` bytes or more goes, or one that is the whole text; shorter repeats, such as words
that any two texts share, stay. A byte that goes thus has an equal one at an earlier place, and texts in which no
``PASSAGE`` bytes repeat lose nothing. Chunks that share too little with the first place on either side are left out
early, by hashes of these sides. Texts are chunked in parts of ``byte_runs.PIECE`` bytes; runs grow across them.

Null texts are empty and lose nothing. Rows that repeat an id and its text are one document. A null id sorts first. Every
input row gives one output row. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import stage
from . import byte_runs as B
from .common import map_arrow, parts
from .repeats import bitmap_of, listed, split_rows
from .shingles import BYTE_VALUES

WINDOW = 32
TOP_BITS = 5
LEAST, MOST = 16, 256
#: The least bytes of a passage that goes, and those by which a run may grow on a side.
PASSAGE, REACH = 200, 256
GEAR = (BYTE_VALUES >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: the sum over the window of the bytes' values, shifted once for each byte since."""
    value, span = GEAR[data], 1
    while span < WINDOW:
        value = value.copy()
        value[span:] += value[:-span] << np.uint32(span)
        span *= 2
    return value


def own_hashes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte without the bytes before its text; chunks may be shorter than the window."""
    value = gear_hashes(data)
    begin, shift = places[1:-1], np.arange(1, WINDOW)
    at = begin[:, None] + shift - 1
    near = at < places[2:, None]
    out = value.copy()
    out[at[near]] -= (value[begin - 1][:, None] << shift.astype(np.uint32))[near]
    return out


def chunk_ends(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place (exclusive) of every chunk; none crosses ``places``, the begins of texts and the end."""
    ends = np.flatnonzero(own_hashes(data, places) >> np.uint32(32 - TOP_BITS) == 0) + 1
    out: list[int] = []
    cuts = np.searchsorted(ends, places).tolist()
    listed_ends, bounds = ends.tolist(), places.tolist()
    starts: list[int] = []
    for i, (at, stop) in enumerate(zip(bounds[:-1], bounds[1:])):
        for end in listed_ends[cuts[i] : cuts[i + 1]]:
            while end - at > MOST:
                starts.append(at)
                at += MOST
                out.append(at)
            if end - at >= LEAST:
                starts.append(at)
                out.append(end)
                at = end
        while at < stop:
            starts.append(at)
            at = min(stop, at + MOST)
            out.append(at)
    return np.array(starts, np.int64), np.array(out, np.int64)


def _chunks(texts: pa.Array):
    """By piece: its hashes, the places of its parts, and of its chunks the first and last place, the hash, the part, the
    row, and the place in the text, and its bytes."""
    for data, rows, places, bases in B.pieces(texts, 0):
        first, last = chunk_ends(data, places)
        part = np.searchsorted(places, first, "right") - 1
        stretches = B.Stretches(data)
        yield (
            stretches, places, first, last, stretches.between(first, last), part, rows[part],
            first - places[part] + bases[part], data,
        )


def flanks(
    stretches: B.Stretches, places: np.ndarray, first: np.ndarray, last: np.ndarray, part: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits, not negative) of the bytes before and after chunks, as many as one side at least must share with
    the first place for a passage of ``PASSAGE`` bytes; -1 where the part has fewer.
    """
    width = np.maximum(0, -(-(PASSAGE - (last - first)) // 2))
    out = []
    for begin, end in ((first - width, first), (last, last + width)):
        inside = (begin >= places[part]) & (end <= places[part + 1])
        h = stretches.between(np.where(inside, begin, first), np.where(inside, end, last))
        out.append(np.where(inside, (h >> np.uint64(33)).astype(np.int64), -1))
    return out[0], out[1]


def later_chunks(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key`` and ``chunks`` of each text that holds chunks with an earlier place; ``rows`` as from ``keyed``.

    A chunk is its ``start`` and ``end``, and the text (``sd``, ``sk``) and start (``ss``) of the first place.
    """

    def count(batch: pa.RecordBatch):
        for _, _, _, _, h, _, _, _, _ in _chunks(batch.column(0)):
            h, n = np.unique(h, return_counts=True)
            yield {"h": pa.array(h.view(np.int64)), "n": pa.array(n)}

    counts = map_arrow(rows.select("text"), count, "h bigint, n bigint")
    often = stage(counts.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "chunks")
    bitmap = rows.sparkSession.sparkContext.broadcast(bitmap_of(often, often.count()))

    def sign(batch: pa.RecordBatch):
        sizes = pa.compute.binary_length(batch.column(2)).to_numpy()
        for stretches, places, first, last, h, part, row, at, data in _chunks(batch.column(2)):
            keep = listed(bitmap.value, h)
            first, last, part, row, at = first[keep], last[keep], part[keep], row[keep], at[keep]
            body = data.tobytes()
            before, after = flanks(stretches, places, first, last, part)
            # parts of long texts, and texts that may go whole though they are short
            open_ = (sizes[row] < PASSAGE) | (sizes[row] != np.diff(places)[part])
            spans = zip(first.tolist(), last.tolist())
            owner = pa.array(row)
            yield {
                "digest": [hashlib.blake2b(body[a:b], digest_size=16).digest() for a, b in spans],
                "doc_id": batch.column(0).take(owner), "text_key": batch.column(1).take(owner),
                "start": pa.array(at), "end": pa.array(at + last - first),
                "before": pa.array(before), "after": pa.array(after), "open": pa.array(open_),
            }

    schema = (
        "digest binary, doc_id bigint, text_key bigint, start bigint, end bigint, before int, after int, open boolean"
    )
    signed = stage(map_arrow(rows.select("doc_id", "text_key", "text"), sign, schema), "digests")
    place = F.struct("doc_id", "text_key", "start", "before", "after", "open")
    firsts = signed.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = signed.join(firsts.select("digest", "first"), "digest").where(~place.eqNullSafe(F.col("first")))
    # a run that reaches PASSAGE bytes shares half of what its chunk lacks on one side at least
    alike = (F.col("before") >= 0) & (F.col("before") == F.col("first.before"))
    alike |= (F.col("after") >= 0) & (F.col("after") == F.col("first.after"))
    later = later.where(alike | F.col("open") | F.col("first.open"))
    chunk = F.struct(
        "start", "end", F.col("first.doc_id").alias("sd"), F.col("first.text_key").alias("sk"), F.col("first.start").alias("ss")
    )
    # a set, so that rows which repeat an id and its text add nothing
    return later.groupBy("doc_id", "text_key").agg(F.collect_set(chunk).alias("chunks"))


def runs_of(chunks: list[tuple]) -> list[tuple]:
    """Runs of chunks ``(start, end, sd, sk, ss)`` that follow each other here and at their first places."""
    out: list[tuple] = []
    for start, end, sd, sk, ss in sorted(chunks, key=lambda c: c[0]):
        if out:
            a, b, d, k, s = out[-1]
            if b == start and (d, k) == (sd, sk) and s - a == ss - start:
                out[-1] = (a, end, d, k, s)
                continue
        out.append((start, end, sd, sk, ss))
    return out


def _joined_runs(batch: pa.RecordBatch):
    names = ("start", "end", "sd", "sk", "ss")
    for part in parts(batch):
        out: dict[str, list] = {c: [] for c in ("doc_id", "text_key", "run", *names)}
        for doc, key, chunks in zip(*(c.to_pylist() for c in part.columns)):
            for i, run in enumerate(runs_of([tuple(c[n] for n in names) for c in chunks])):
                for c, v in zip(out, (doc, key, i, *run)):
                    out[c].append(v)
        yield out


def _surroundings(batch: pa.RecordBatch):
    """The bytes before (even edges) or after (odd ones) the places ``edge // 2`` that are asked of a text."""
    for part in parts(batch):
        out: dict[str, list] = {c: [] for c in ("sd", "sk", "edge", "near")}
        for doc, key, edges, text in zip(*(c.to_pylist() for c in part.columns[:3]), part.column(3)):
            body = text.as_buffer().to_pybytes()
            for edge in edges:
                at = edge // 2
                near = body[at : at + REACH] if edge & 1 else body[max(0, at - REACH) : at]
                for c, v in zip(out, (doc, key, edge, near)):
                    out[c].append(v)
        yield out


def with_surroundings(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """Two rows for each run: ``doc_id``, ``text_key`` and ``runs`` (its number, start, end, side, and the bytes on that
    side of its first place).

    A first place is asked for once, however many texts repeat it.
    """
    last = F.col("ss") + F.col("end") - F.col("start")
    sides = F.explode(F.array(F.col("ss") * 2, last * 2 + 1)).alias("edge")
    ends = runs.select("doc_id", "text_key", "run", "start", "end", "sd", "sk", sides)
    asked = stage(ends.groupBy("sd", "sk").agg(F.collect_set("edge").alias("edges")), "asked")
    some, _ = split_rows(rows, asked.select(F.col("sd").alias("doc_id"), F.col("sk").alias("text_key")))
    bodies = some.groupBy("doc_id", "text_key").agg(F.first("text").alias("text"))
    held = asked.join(bodies, F.col("sd").eqNullSafe(F.col("doc_id")) & (F.col("sk") == F.col("text_key")))
    near = map_arrow(
        held.select("sd", "sk", "edges", "text"), _surroundings, "sd bigint, sk bigint, edge bigint, near binary"
    ).select(F.col("sd").alias("nd"), F.col("sk").alias("nk"), F.col("edge").alias("ne"), "near")
    same = F.col("sd").eqNullSafe(F.col("nd")) & (F.col("sk") == F.col("nk")) & (F.col("edge") == F.col("ne"))
    run = F.struct("run", "start", "end", (F.col("edge") % 2).alias("side"), "near")
    return ends.join(near, same).select("doc_id", "text_key", F.array(run).alias("runs"))


def common_bytes(a: bytes, b: bytes) -> int:
    """The number of bytes at the begin that ``a`` and ``b`` share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0  # a[:low] agrees, a[:n] doesn't
    while n - low > 1:
        middle = (low + n) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            n = middle
    return low


def grown(least: int):
    """What goes of a text: its runs, grown, if they reach ``least`` bytes or are the whole text."""

    def grow(body: bytes, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole: dict[int, list[int]] = {}
        for r in runs.to_pylist():
            span = whole.setdefault(r["run"], [r["start"], r["end"]])
            if r["side"]:
                span[1] += common_bytes(body[r["end"] : r["end"] + REACH], r["near"])
            else:
                span[0] -= common_bytes(body[max(0, r["start"] - REACH) : r["start"]][::-1], r["near"][::-1])
        long = [(a, b) for a, b in whole.values() if b - a >= least or b - a == len(body)]
        start, end = np.array(long, np.int64).reshape(-1, 2).T
        return start, end

    return grow


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = PASSAGE) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and the bytes ``kept`` of every row."""
    rows = B.keyed(docs, id, text)
    schema = "doc_id bigint, text_key bigint, run int, start bigint, end bigint, sd bigint, sk bigint, ss bigint"
    runs = stage(map_arrow(later_chunks(rows), _joined_runs, schema), "runs")
    return B.remove_runs(rows, B.gather_runs(with_surroundings(runs, rows)), grown(least))
