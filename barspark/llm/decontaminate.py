"""Benchmark decontamination by a broadcast hash set of normalised word windows.

Words: A-Z lower-cased, then runs of ASCII letters and digits or anything beyond ASCII. A window is ``width``
consecutive words of an item; an item of fewer words, but not none, is one window. Every document word inside
an occurrence of a window is hit. Document windows are compared by a 64-bit hash of their words first and by
the words themselves after that.

The benchmark goes out in slices of at most ``SLICE_CHARS`` characters, so what a task holds is bounded whatever
its size: each slice gives the hits of its items, and the hits of a document are united afterwards. Usually
there is one slice, and no shuffle.

Null and empty texts have no words, hence no hits. Items without words or with a null id are left out; two items
with equal text both count; rows that repeat an item id are that item's texts. Every input row gives one output row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import stage
from .common import PLAIN_WORD, ascii_lower, map_arrow, with_text_last

WIDTH = 10
#: The most characters of benchmark text (and items) that one broadcast slice holds.
SLICE_CHARS = 16_000_000
SLICE_ITEMS = 100_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return PLAIN_WORD.findall(ascii_lower(text)) if text else []


class Windows:
    """The windows of some items: word numbers, window hashes by window length, and the items of each window."""

    def __init__(self, items: list[tuple[int, str | None]], width: int) -> None:
        self.vocabulary: dict[str, int] = {}
        self.items: dict[tuple[int, ...], list[int]] = {}
        for item, text in items:
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            size = min(width, len(numbers))
            for at in range(len(numbers) - size + 1 if size else 0):
                holders = self.items.setdefault(tuple(numbers[at : at + size]), [])
                if not holders or holders[-1] != item:
                    holders.append(item)
        by_size: dict[int, list[tuple[int, ...]]] = {}
        for window in self.items:
            by_size.setdefault(len(window), []).append(window)
        self.hashes = {n: np.unique(rolling(np.array(ws, np.uint64), n)[:, 0]) for n, ws in by_size.items()}

    def find(self, words: list[str]) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the items found."""
        hit = np.zeros(len(words), bool)
        found: set[int] = set()
        numbers = np.fromiter(map(self.vocabulary.get, words, [0] * len(words)), np.int64, len(words))
        known = numbers > 0
        for n, hashes in self.hashes.items():
            if len(words) < n:
                continue
            # only windows whose words all occur in the benchmark can match
            gaps = np.concatenate(([0], np.cumsum(~known)))
            starts = np.flatnonzero(gaps[n:] == gaps[:-n])
            if not len(starts):
                continue
            values = rolling(numbers[starts[:, None] + np.arange(n)].astype(np.uint64), n)[:, 0]
            place = np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)
            for at in starts[hashes[place] == values].tolist():
                if holders := self.items.get(tuple(numbers[at : at + n].tolist())):
                    hit[at : at + n] = True
                    found.update(holders)
        return hit, found


def rolling(numbers: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each row of word numbers."""
    value = np.zeros((len(numbers), 1), np.uint64)
    for k in range(n):
        value = (value ^ numbers[:, k : k + 1]) * MIX
        value ^= value >> np.uint64(29)
    return value


def _slices(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str | None]]]:
    """The items in slices of bounded size, through an iterator that holds one partition at a time."""
    rows = benchmark.select(F.col(f"`{item}`").alias("i"), F.col(f"`{text}`").cast("string").alias("t"))
    part: list[tuple[int, str | None]] = []
    size = 0
    for row in rows.where("i is not null and t is not null").distinct().toLocalIterator():
        if part and (size + len(row.t) > SLICE_CHARS or len(part) >= SLICE_ITEMS):
            yield part
            part, size = [], 0
        part.append((row.i, row.t))
        size += len(row.t)
    yield part


HITS = "hits array<struct<start: int, end: int>>, items array<bigint>, n_words bigint"


def _hits_of(df: DataFrame, keep: list[str], text: str, items: list[tuple[int, str | None]], width: int) -> DataFrame:
    """For each row: the runs of hit words (numbers, end exclusive), the items found and the count of words."""
    shared = df.sparkSession.sparkContext.broadcast(Windows(items, width))

    def run(batch: pa.RecordBatch):
        windows: Windows = shared.value
        hits, found, counts = [], [], []
        for t in batch.column(batch.num_columns - 1).to_pylist():
            words = words_of(t)
            hit, items = windows.find(words)
            edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
            hits.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
            found.append(sorted(items))
            counts.append(len(words))
        yield {c: batch.column(i) for i, c in enumerate(keep)} | {"hits": hits, "items": found, "n_words": counts}

    source = with_text_last(df, keep, text)
    extra = T.StructType.fromDDL(HITS).fields
    return map_arrow(source, run, T.StructType([*source.schema.fields[:-1], *extra]))


def merge_runs(runs):
    """Unite sorted runs that touch or overlap."""
    return F.aggregate(
        runs,
        F.array().cast("array<struct<start: int, end: int>>"),
        lambda out, x: F.when(
            (F.size(out) > 0) & (F.element_at(out, -1)["end"] >= x["start"]),
            F.concat(
                F.slice(out, F.lit(1), F.size(out) - 1),
                F.array(F.struct(
                    F.element_at(out, -1)["start"].alias("start"),
                    F.greatest(F.element_at(out, -1)["end"], x["end"]).alias("end"),
                )),
            ),
        ).otherwise(F.concat(out, F.array(x))),
    )


def find_hits(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", width: int = WIDTH,
) -> DataFrame:
    """``id``, ``hits`` (runs of hit words), ``items`` (found item ids) and ``n_words`` of each document."""
    slices = _slices(benchmark, item, item_text)
    part, following = next(slices), next(slices, None)
    if following is None:
        return _hits_of(docs, [id], text, part, width)
    # one row of a document for each slice; its text's hash tells documents of one id apart
    docs = docs.select(id, text, F.xxhash64(F.col(f"`{text}`")).alias("_key"))
    found = []
    for part in chain([part, following], slices):  # written, so the driver holds one slice at a time
        found.append(stage(_hits_of(docs, [id, "_key"], text, part, width), "hits"))
    whole = reduce(DataFrame.unionByName, found)
    return (
        whole.groupBy(F.col(f"`{id}`"), "_key", "n_words")
        .agg(
            F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.expr(f"count(*) div {len(found)}").alias("_copies"),
        )
        .withColumn("hits", merge_runs(F.col("hits")))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
        .select(id, "hits", "items", "n_words")
    )


def _cut(text: str, hit: np.ndarray, least_left: int) -> str | None:
    """The text without the hit words; ``None`` if fewer than ``least_left`` words remain."""
    if len(hit) - int(hit.sum()) < least_left:
        return None
    spots = list(PLAIN_WORD.finditer(ascii_lower(text)))
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    out, free = [], 0
    for a, b in edges.reshape(-1, 2).tolist():
        out.append(text[free : spots[a].start()])
        free = spots[b - 1].end()
    return "".join([*out, text[free:]])


def _without_hits(windows: Windows, text: str | None, least_left: int) -> str | None:
    """The text without its hits; ``None`` if fewer than ``least_left`` words remain of a text with hits."""
    while text:  # what closes up over a gap may be a window again
        hit, _ = windows.find(words_of(text))
        if not hit.any():
            break
        text = _cut(text, hit, least_left)
    return text


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", least_left: int = 1, width: int = WIDTH) -> DataFrame:
    """The documents without their hit words and what stands between these; other texts stay as they are.

    A document of which fewer than ``least_left`` words would remain goes whole. With several slices each marks its hits
    on the unchanged text, and the text is cut once by all of them; texts that were cut are searched again by every
    slice, until none has a hit. The result is that of one slice, however the items fall into slices.
    """
    columns = docs.columns
    place = columns.index(text)
    slices = _slices(benchmark, "item_id", "text")
    part, following = next(slices), next(slices, None)
    if following is None:
        shared = docs.sparkSession.sparkContext.broadcast(Windows(part, width))

        def run(batch: pa.RecordBatch):
            before = batch.column(place).to_pylist()
            after = [_without_hits(shared.value, t, least_left) for t in before]
            kept = [i for i, (t, u) in enumerate(zip(before, after)) if t is None or u is not None]
            rest = batch.take(pa.array(kept, pa.int64()))
            yield {c: rest.column(i) for i, c in enumerate(columns)} | {text: [after[i] for i in kept]}

        return map_arrow(docs, run, docs.schema)

    mark = "_hits"
    while mark in columns:
        mark += "_"
    done, slices = [], chain([part, following], slices)
    while True:
        marked = docs.withColumn(mark, F.lit(None).cast("binary"))
        for part in slices:  # written, so the driver holds one slice at a time
            marked = stage(_marked(marked, part, columns, text, mark, width), "marked")
        done.append(marked.where(F.col(mark).isNull()).drop(mark))
        marked = marked.where(F.col(mark).isNotNull())
        if marked.isEmpty():
            return reduce(DataFrame.unionByName, done)

        def cut(batch: pa.RecordBatch):
            texts, hits = (batch.column(i).to_pylist() for i in (place, len(columns)))
            after = [_cut(t, np.frombuffer(h, bool), least_left) for t, h in zip(texts, hits)]
            kept = [i for i, t in enumerate(after) if t is not None]
            rest = batch.take(pa.array(kept, pa.int64()))
            yield {c: rest.column(i) for i, c in enumerate(columns)} | {text: [after[i] for i in kept]}

        docs, slices = stage(map_arrow(marked, cut, docs.schema), "cut"), _slices(benchmark, "item_id", "text")


def _marked(
    df: DataFrame, items: list[tuple[int, str | None]], columns: list[str], text: str, mark: str, width: int
) -> DataFrame:
    """The rows with ``mark`` (a byte for each word, null without hits) united with the hits of these items."""
    shared = df.sparkSession.sparkContext.broadcast(Windows(items, width))
    place = columns.index(text)

    def run(batch: pa.RecordBatch):
        marks = batch.column(len(columns)).to_pylist()
        for i, t in enumerate(batch.column(place).to_pylist()):
            hit, _ = shared.value.find(words_of(t))
            if hit.any():
                marks[i] = (hit if marks[i] is None else hit | np.frombuffer(marks[i], bool)).tobytes()
        yield {c: batch.column(i) for i, c in enumerate(columns)} | {mark: marks}

    return map_arrow(df, run, df.schema)


def digest(hits: DataFrame) -> DataFrame:
    """The result columns of the registered query."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]).cast("long"))
    ids = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )
