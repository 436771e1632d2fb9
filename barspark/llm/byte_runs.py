"""Byte positions of texts: polynomial hashes of any stretch, pieces of a batch, and the removal of runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import stage
from .common import map_arrow
from .repeats import split_rows
from .shingles import BYTE_VALUES, mix, text_bytes

#: An odd base and its inverse modulo 2 ** 64.
ODD_BASE = 0xD6E8FEB86659FD93
INVERSE = pow(ODD_BASE, -1, 1 << 64)
#: Bytes that are worked on at a time.
PIECE = 1_000_000


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    np.multiply.accumulate(np.full(n - 1, base, np.uint64), out=out[1:])
    return out


class Stretches:
    """Hashes of stretches of ``data`` in constant time each."""

    tables: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __init__(self, data: np.ndarray) -> None:
        if len(Stretches.tables[0]) <= len(data):
            n = max(len(data) + 1, PIECE + 4096)
            Stretches.tables = _powers(ODD_BASE, n), _powers(INVERSE, n)
        up, self.down = Stretches.tables
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=self.sums[1:])

    def windows(self, size: int) -> np.ndarray:
        """The hash of the ``size`` bytes from each place on."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:-size]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)

    def between(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(((self.sums[end] - self.sums[begin]) * self.down[begin]) ^ (end - begin).astype(np.uint64))


def pieces(texts: pa.Array, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of about ``PIECE``; for each part of a text in them its row, its place there, and its place in the text.

    Longer texts are cut, and a part then ends with ``overlap`` bytes that the next one begins with. The last array
    has the end of each part.
    """
    flat, offsets = text_bytes(texts)
    rows, begins, ends, bases = [], [], [], []
    size = 0

    def out():
        lengths = np.array(ends) - np.array(begins)
        places = np.concatenate(([0], np.cumsum(lengths)))
        contiguous = len(begins) == 1 or all(a == b for a, b in zip(ends, begins[1:]))
        data = flat[begins[0] : ends[-1]] if contiguous else np.concatenate([flat[a:b] for a, b in zip(begins, ends)])
        return data, np.array(rows), places, np.array(bases)

    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        at = a
        while at < b:
            stop = min(b, at + PIECE)
            if size and size + stop - at > PIECE:
                yield out()
                rows, begins, ends, bases, size = [], [], [], [], 0
            rows.append(row)
            begins.append(at)
            ends.append(stop)
            bases.append(at - a)
            size += stop - at
            if stop == b:
                break
            at = stop - overlap
    if rows:
        yield out()


def keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``doc_id``, ``text_key`` (a hash that tells texts of one id apart) and ``text``; null texts are empty."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id}`").cast("bigint").alias("doc_id"), F.xxhash64(body).alias("text_key"), body.alias("text"))


RUNS = "array<struct<start: bigint, end: bigint>>"


def gather_runs(found: DataFrame) -> DataFrame:
    """``runs`` of each text, from rows ``doc_id``, ``text_key`` and ``runs``; a text has as many as its length allows."""
    return found.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def remove_runs(rows: DataFrame, runs: DataFrame, grow: Callable[[bytes, pa.Array], tuple] | None = None) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and the bytes ``kept`` of each row without its runs.

    ``rows`` as from ``keyed``, ``runs`` as from ``gather_runs``; runs may touch or overlap and are in no order. ``grow``
    makes the starts and ends of what goes from a text's bytes and its runs; without it the runs themselves go. Texts
    without runs aren't shuffled.
    """
    runs = stage(runs, "cuts")
    some, others = split_rows(rows, runs)
    runs = runs.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "runs")
    both = some.join(runs, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")

    def cut(batch: pa.RecordBatch):
        out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept")}
        texts, found = batch.column(1), batch.column(2)
        for i in range(batch.num_rows):
            body = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""
            own = found[i].values if found[i].is_valid else None
            removed, spans, kept = 0, 0, body
            if own is not None and len(own):
                start, end = grow(body, own) if grow else (own.field(c).to_numpy() for c in ("start", "end"))
                order = np.argsort(start, kind="stable")
                start, end = start[order], np.maximum.accumulate(end[order])
                first = np.concatenate(([True], start[1:] > end[:-1]))[: len(start)]
                starts, ends = start[first], end[np.append(first[1:], True)[: len(end)]]
                spans, removed = len(starts), int((ends - starts).sum())
                edges = [0, *np.stack([starts, ends], axis=1).reshape(-1).tolist(), len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
            for c, v in zip(out, (len(body), removed, spans, kept)):
                out[c].append(v)
        yield {"doc_id": batch.column(0), **out}

    none = F.lit(0).cast("bigint")
    whole = others.select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"),
        F.col("text").cast("binary").alias("kept"),
    )
    return map_arrow(
        both.select("doc_id", "text", "runs"), cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    ).unionByName(whole)


def digest(cut: DataFrame) -> DataFrame:
    """The result columns of the registered queries."""
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
