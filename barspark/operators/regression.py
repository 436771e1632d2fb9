"""Least squares for many outputs in one pass over a store of samples.

A sample's inputs are the rows of its window, so that the products of two inputs, summed over samples, depend on how far
apart their rows are and hardly on where the window lies: from one place in the window to the next only the samples at
the ends of a series drop out and come in. A task therefore sums the products of each window's first row with all its
rows (``columns * window * columns`` numbers, in place of the square of ``window * columns``), and hands on the
``window - 1`` rows at either end of each series. The products of those rows, which are few, are summed in tasks of their
own; with both sums the whole matrix is put together on the driver. Its size is given by the window and the columns, and
does not grow with the rows. It serves all outputs and all regularisations.

Sums of tasks are cut into tiles, which are added up in groups of ``FAN`` at most until one is left.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import stage
from .blocks import in_batches

#: Numbers in a tile, partial sums that are added together, and ends of series whose products a task sums.
TILE, FAN, ENDS = 65_536, 64, 4096
PARTIAL = "kind string, tile int, part bigint, value array<double>"


@dataclass
class Moments:
    """Sums over the samples: how many, inputs, outputs, products of inputs, of inputs and outputs, squares of outputs."""

    samples: int
    x: np.ndarray
    y: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray

    @cached_property
    def _axes(self) -> tuple[np.ndarray, np.ndarray]:
        """Variances along the principal axes of the inputs, and the axes: taken apart once for all regularisations."""
        mean = self.x / self.samples
        return np.linalg.eigh(self.xx / self.samples - np.outer(mean, mean))

    def solve(self, reg: float) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients (inputs x outputs) and intercepts that minimise half the mean squared error plus a penalty.

        The penalty is half the squared coefficients times ``reg`` divided by the output's standard deviation, as in
        ``pyspark.ml``. Without one the shortest coefficients are taken. A constant output has coefficients 0.
        """
        mean_x, mean_y = self.x / self.samples, self.y / self.samples
        deviation = np.sqrt(np.maximum(self.yy / self.samples - mean_y**2, 0))
        varies = deviation > 1e-12 * np.maximum(1, np.abs(mean_y))
        variance, axes = self._axes
        along = axes.T @ (self.xy / self.samples - np.outer(mean_x, mean_y))
        weight = variance[:, None] + reg / np.where(varies, deviation, 1)
        usable = weight > len(variance) * np.finfo(float).eps * max(variance.max(), 0)
        coefficients = axes @ np.where(usable, along / np.where(usable, weight, 1), 0) * varies
        return coefficients, mean_y - mean_x @ coefficients


def _tiles(kind: str, part: int, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    for tile, at in enumerate(range(0, len(values), TILE)):
        yield _partial([kind], [tile], [part], [values[at : at + TILE]])


def _partial(kinds, tiles, parts, values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.string()), pa.array(tiles, pa.int32()), pa.array(parts, pa.int64()), pa.array(values, pa.list_(pa.float64()))],
        names=["kind", "tile", "part", "value"],
    )


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def tree_sum(partials: DataFrame) -> DataFrame:
    """The sum of each ``tile``; no group has more than ``FAN`` partial sums."""

    def add(table: pa.Table) -> pa.Table:
        total = None
        for value in table["value"]:
            own = value.values.to_numpy()
            total = own.copy() if total is None else total + own
        kept = {"tile": table["tile"][:1], "part": table["part"][:1], "value": pa.array([total], pa.list_(pa.float64()))}
        return pa.table(kept)

    schema = "tile int, part bigint, value array<double>"
    rows = partials.select("tile", "part", "value")
    last = rows.agg(F.max("part").alias("part")).first().part
    while last is not None and last >= FAN:
        rows = rows.withColumn("part", F.expr(f"part div {FAN}")).groupBy("tile", "part").applyInArrow(add, schema)
        last //= FAN
    return rows.groupBy("tile").applyInArrow(add, schema)


def _collected(sums: DataFrame) -> np.ndarray:
    """The tiles of a sum, one after the other; their number is given by the window and the columns."""
    tiles = sorted(((r.tile, r.value) for r in sums.select("tile", "value").collect()), key=lambda t: t[0])
    return np.concatenate([np.array(v, np.float64) for _, v in tiles]) if tiles else np.zeros(0)


def moments(blocks: DataFrame, window: int, horizon: int, inputs: int, outputs: int) -> Moments:
    """The sums over the samples of ``blocks``, read once; ``inputs`` and ``outputs`` are the numbers of columns."""
    wide, out, late = window * inputs, horizon * outputs, (window - 1) * inputs
    sizes = [1, wide, out, out, inputs * wide, wide * out]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = _task(), None
        for block in in_batches(batches, window, inputs, outputs):
            x, y = block.windows(window), block.targets(horizon)
            if total is None:
                total = [np.zeros(1), np.zeros(wide), np.zeros(out), np.zeros(out), np.zeros((inputs, wide)), np.zeros((wide, out))]
            own_sums = (len(x), x.sum(axis=0), y.sum(axis=0), (y * y).sum(axis=0), x[:, :inputs].T @ x, x.T @ y)
            for t, own in zip(total, own_sums):
                t += own
            m = block.high - block.low
            ends = (("begin", block.begins, block.x[: window - 1]), ("end", block.ends, block.x[m : m + window - 1]))
            for kind, there, rows in ends:
                if there and late:
                    yield _partial([kind], [0], [part], [rows.reshape(-1)])
        if total is not None:
            yield from _tiles("sum", part, np.concatenate([t.reshape(-1) for t in total]))

    partials = stage(blocks.mapInArrow(sums, PARTIAL), "moments")
    flat = _collected(tree_sum(partials.where("kind = 'sum'")))
    if not len(flat):
        raise ValueError("there are no samples to fit on")
    if not np.isfinite(flat).all():
        raise ValueError("missing or infinite values in the samples: clean the rows first")
    n, x, y, yy, first, xy = np.split(flat, np.cumsum(sizes)[:-1])
    change = _end_products(partials.where("kind <> 'sum'"), late)

    # rows i and j of the window: those one row earlier, with the changes at the ends of the series
    xx = np.zeros((wide, wide))
    xx[:inputs] = first.reshape(inputs, wide)
    for i in range(inputs, wide, inputs):
        xx[i : i + inputs, i:] = xx[i - inputs : i, i - inputs : wide - inputs] + change[i - inputs : i, i - inputs :]
    upper = np.triu(xx)
    return Moments(int(n[0]), x, y, upper + np.triu(xx, 1).T, xy.reshape(wide, out), yy)


def _end_products(ends: DataFrame, late: int) -> np.ndarray:
    """Summed products of the rows at the ends of series, less those at the beginnings."""
    if not late:
        return np.zeros((0, 0))
    tasks = -(-ends.count() // ENDS)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = _task(), np.zeros((late, late))
        for batch in batches:
            rows = batch.column(3).values.to_numpy(zero_copy_only=False)
            offsets = batch.column(3).offsets.to_numpy()
            rows = rows[offsets[0] : offsets[-1]].reshape(-1, late)
            sign = np.where(np.array(batch.column(0).to_pylist()) == "end", 1.0, -1.0)
            total += (rows * sign[:, None]).T @ rows
        yield from _tiles("ends", part, total.reshape(-1))

    partials = stage(ends.repartition(max(1, tasks)).mapInArrow(products, PARTIAL), "end-products")
    return _collected(tree_sum(partials)).reshape(late, late)


def validation_losses(
    blocks: DataFrame, models: Sequence[tuple[np.ndarray, np.ndarray]], window: int, horizon: int, inputs: int, outputs: int
) -> DataFrame:
    """``model_id, val_mse``: the mean squared error over all outputs, for all models in one pass."""
    shared = blocks.sparkSession.sparkContext.broadcast(list(models))

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, count = [0.0] * len(shared.value), 0
        for block in in_batches(batches, window, inputs, outputs):
            x, y = block.windows(window), block.targets(horizon)
            count += y.size
            for k, (coefficients, intercepts) in enumerate(shared.value):
                totals[k] += float(((x @ coefficients + intercepts - y) ** 2).sum())
        ids = list(range(len(totals)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int32()), pa.array(totals, pa.float64()), pa.array([count] * len(ids), pa.int64())],
            names=["model_id", "e", "n"],
        )

    sums = blocks.mapInArrow(errors, "model_id int, e double, n bigint").groupBy("model_id")
    return sums.agg((F.sum("e") / F.nullif(F.sum("n"), F.lit(0))).alias("val_mse"))


def score_blocks(
    blocks: DataFrame, model: tuple[np.ndarray, np.ndarray], window: int, horizon: int, inputs: int, outputs: int, close: int
) -> DataFrame:
    """The samples of ``blocks`` with ``y_hat``, and ``close_now``, the input column ``close`` of the window's last row."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coefficients, intercepts = shared.value
        out = horizon * outputs
        for block in in_batches(batches, window, inputs, outputs):
            m = block.high - block.low
            ids = np.arange(block.low, block.high)
            stops = pa.array(np.arange(0, m * out + 1, out), pa.int32())

            def lists(values: np.ndarray) -> pa.Array:
                return pa.ListArray.from_arrays(stops, pa.array(values.reshape(-1), pa.float64()))

            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block.symbol] * m, pa.string()), pa.array(ids + window, pa.int64()),
                    pa.array(np.full(m, block.n), pa.int64()), pa.array(ids, pa.int64()),
                    pa.array(block.x[window - 1 : window - 1 + m, close], pa.float64()),
                    lists(block.targets(horizon)), lists(block.windows(window) @ coefficients + intercepts),
                ],
                names=["symbol", "rn", "n", "sample_id", "close_now", "y", "y_hat"],
            )

    schema = "symbol string, rn bigint, n bigint, sample_id bigint, close_now double, y array<double>, y_hat array<double>"
    return blocks.mapInArrow(run, schema)
