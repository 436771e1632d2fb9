"""Nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised by codebooks of their own, so ``CODES`` centroids a half give ``CODES ** 2``
cells. A query visits the pairs of centroids by falling summed inner product (the nearest first), taken from a heap,
until the cells seen hold the wanted share of all rows; those rows are ranked by their exact inner product in double
precision.

Codebooks are fitted on at most about ``SAMPLE`` vectors, chosen by a hash of the id; every row is indexed. The share of
rows to visit is found on the same sample: the least at which ``PROBES`` of its vectors, searched in the sample, find
``RECALL`` of their true neighbours there. Both are the documented bounds of what the driver holds, besides a count for
each cell.

Rows are dealt to blocks of about ``BLOCK`` by cell; a cell with more than a quarter of that is split, so one cell may
hold any share of the rows. A query goes once to each block that holds its cells and brings back its best there. The
queries of a block are dealt to parts of about ``ASKED``, each with a copy of the block's rows, so what a task holds at a
time does not grow with the table.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a null id,
nor vectors whose dimension is not the commonest (of equals the larger). Of rows that repeat an id one counts. A query
never meets its own id. Ties go to the smaller id. Without vectors there are no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans import stage
from .common import map_arrow
from .shingles import GOLD, mix

CODES = 64
SAMPLE = 16_000
PROBES = 200
RECALL = 0.96
BLOCK = 8192
#: Queries that meet a block in one group.
ASKED = 4096
#: Queries that a group compares at a time.
AT_ONCE = 256


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, of one length, as double precision rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _nearest_code(points: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.argmin((codes * codes).sum(axis=1) - 2 * points @ codes.T, axis=1)


def k_means(points: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    distinct = np.unique(points, axis=0)
    codes = distinct[np.random.default_rng(seed).choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        own = _nearest_code(points, codes)
        for c in range(len(codes)):
            if (own == c).any():
                codes[c] = points[own == c].mean(axis=0)
    return codes


class MultiIndex:
    """Two codebooks and the count of rows in each cell."""

    def __init__(self, sample: np.ndarray, codes: int) -> None:
        self.half = sample.shape[1] // 2
        self.left, self.right = k_means(sample[:, : self.half], codes), k_means(sample[:, self.half :], codes, seed=1)
        self.counts = np.zeros(self.cells, np.int64)

    @property
    def cells(self) -> int:
        return len(self.left) * len(self.right)

    def cell_of(self, vectors: np.ndarray) -> np.ndarray:
        return _nearest_code(vectors[:, : self.half], self.left) * len(self.right) + _nearest_code(
            vectors[:, self.half :], self.right
        )

    def visit(self, query: np.ndarray, wanted: int) -> list[int]:
        """Cells with rows, nearest first, until they hold ``wanted`` rows."""
        a, b = self.left @ query[: self.half], self.right @ query[self.half :]
        i_of, j_of = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        a, b = a[i_of].tolist(), b[j_of].tolist()
        i_of, j_of, counts, width = i_of.tolist(), j_of.tolist(), self.counts, len(b)
        heap, cells, seen = [(-(a[0] + b[0]), 0, 0)], [], 0
        while heap and seen < wanted:
            _, i, j = heapq.heappop(heap)
            cell = i_of[i] * width + j_of[j]
            if n := int(counts[cell]):
                cells.append(cell)
                seen += n
            if j + 1 < width:
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):  # each pair is pushed once: rows start at column 0
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
        return cells


def share_for(index: MultiIndex, sample: np.ndarray, k: int, recall: float, probes: int) -> float:
    """The least share of the sample to visit so that its probes find ``recall`` of their neighbours."""
    cell = index.cell_of(sample)
    index.counts = np.bincount(cell, minlength=index.cells)
    picked = np.random.default_rng(2).choice(len(sample), min(probes, len(sample)), replace=False)
    needed = []
    for p in picked.tolist():
        scores = sample @ sample[p]
        scores[p] = -np.inf
        best = np.argsort(-scores, kind="stable")[: min(k, len(sample) - 1)]
        order = np.full(index.cells, len(sample), np.int64)
        cells = index.visit(sample[p], len(sample))
        order[cells] = np.cumsum(index.counts[cells])
        needed += order[cell[best]].tolist()
    if not needed:
        return 1.0
    return float(np.quantile(needed, recall, method="higher")) / len(sample)


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """``vec_id`` and ``v`` (double precision) of the rows that take part."""
    rows = vectors.select(F.col(f"`{id}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~odd & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    best = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    rows = rows.where(F.size("v") == (best.d if best else 0))
    return stage(rows.dropDuplicates(["vec_id"]), "vectors")


def search(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", queries=None, k: int = 20, codes: int = CODES,
    recall: float = RECALL, block: int = BLOCK,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` nearest rows found for each query.

    ``queries`` is a condition on ``vec_id`` (ids divisible by 20).
    """
    rows = usable(vectors, id, vector)
    total = rows.count()
    if not total:
        return rows.select(
            F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")
        ).limit(0)
    unit = (F.abs(F.xxhash64("vec_id", F.lit(13)) % 1_000_000) + 0.5) / 1_000_000
    drawn = rows.where(unit < SAMPLE / total).orderBy("vec_id").toArrow()
    if not drawn.num_rows:  # by chance of the hash, in a tiny table
        drawn = rows.orderBy("vec_id").limit(SAMPLE).toArrow()
    sample = _matrix(drawn["v"].combine_chunks())
    index = MultiIndex(sample, codes)
    wanted = int(np.ceil(share_for(index, sample, k, recall, PROBES) * total))

    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(index)

    def assign(batch: pa.RecordBatch):
        yield {"vec_id": batch.column(0), "v": batch.column(1), "cell": pa.array(shared.value.cell_of(_matrix(batch.column(1))))}

    cells = stage(map_arrow(rows, assign, "vec_id bigint, v array<double>, cell bigint"), "cells")
    index.counts = np.zeros(index.cells, np.int64)
    for r in cells.groupBy("cell").agg(F.count("*").alias("n")).collect():  # at most codes ** 2
        index.counts[r.cell] = r.n
    full = spark.sparkContext.broadcast(index)
    blocks = -(-total // block)
    split = max(1, block // 4)

    def block_of(cell: np.ndarray, part: np.ndarray) -> np.ndarray:
        return (mix((cell.astype(np.uint64) * GOLD) ^ part.astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)

    def parts_of(cell: np.ndarray) -> np.ndarray:
        return -(-full.value.counts[cell] // split)

    def deal(batch: pa.RecordBatch):
        ids, cell = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        part = mix(ids.astype(np.uint64) + GOLD) % parts_of(cell).astype(np.uint64)
        yield {"block": pa.array(block_of(cell, part)), "vec_id": batch.column(0), "v": batch.column(1), "cell": batch.column(2)}

    def ask(batch: pa.RecordBatch):
        asked_part = mix(batch.column(0).to_numpy().astype(np.uint64) * GOLD + np.uint64(1)) % np.uint64(groups)
        for i, q in enumerate(_matrix(batch.column(1))):
            visited = np.array(full.value.visit(q, wanted), np.int64)
            parts = parts_of(visited)
            cell = np.repeat(visited, parts)
            part = np.arange(len(cell)) - np.repeat(np.cumsum(parts) - parts, parts)
            own = block_of(cell, part)
            order = np.argsort(own, kind="stable")
            own, cell = own[order], cell[order]
            cuts = np.flatnonzero(np.diff(own, prepend=-1))
            yield {
                "block": pa.array(own[cuts]), "part": [int(asked_part[i])] * len(cuts),
                "query_id": [batch.column(0)[i].as_py()] * len(cuts),
                "q": [q.tolist()] * len(cuts),
                "cells": [np.unique(c).tolist() for c in np.split(cell, cuts[1:])],
            }

    condition = F.col("vec_id") % 20 == 0 if queries is None else queries
    chosen = rows.where(condition).select("vec_id", "v")
    groups = max(1, -(-chosen.count() // ASKED))
    dealt = map_arrow(cells, deal, "block bigint, vec_id bigint, v array<double>, cell bigint")
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
    asked = map_arrow(chosen, ask, "block bigint, part bigint, query_id bigint, q array<double>, cells array<bigint>")

    def compare(queries: pa.Table, own: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if queries.num_rows and own.num_rows:
            own = own.sort_by("vec_id")
            ids, v = own["vec_id"].to_numpy(), _matrix(own["v"].combine_chunks())
            names, place = np.unique(own["cell"].to_numpy(), return_inverse=True)
            asks, q = queries["query_id"].to_numpy(), _matrix(queries["q"].combine_chunks())
            for begin in range(0, len(asks), AT_ONCE):
                some = slice(begin, begin + AT_ONCE)
                wanted = np.zeros((len(asks[some]), len(names)), bool)
                for i, cells in enumerate(queries["cells"].slice(begin, AT_ONCE).to_pylist()):
                    at = np.searchsorted(names, cells)
                    wanted[i, at[at < len(names)][names[at[at < len(names)]] == np.array(cells)[at < len(names)]]] = True
                scores = q[some] @ v.T
                scores[~wanted[:, place]] = -np.inf
                for i, row in enumerate(scores):
                    row[ids == asks[begin + i]] = -np.inf
                    n = min(k, len(row))
                    edge = np.partition(row, len(row) - n)[len(row) - n]
                    # rounding of the product may differ from the exact score: keep what is as near, and rank exactly
                    near = np.flatnonzero(row >= edge - 1e-9 * (1 + abs(edge))) if np.isfinite(edge) else np.flatnonzero(np.isfinite(row))
                    exact = (v[near] * q[begin + i]).sum(axis=1)
                    best = np.lexsort((ids[near], -exact))[:k]
                    out["query_id"] += [int(asks[begin + i])] * len(best)
                    out["vec_id"] += ids[near][best].tolist()
                    out["score"] += exact[best].tolist()
        return pa.table({c: pa.array(x, t) for (c, x), t in zip(out.items(), (pa.int64(), pa.int64(), pa.float64()))})

    found = asked.groupBy("block", "part").cogroup(dealt.groupBy("block", "part")).applyInArrow(
        compare, "query_id bigint, vec_id bigint, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
