"""A store of samples that keeps every row once.

A row of the store is a block: a chunk of a series with the ``window - 1`` rows before it and the ``horizon`` rows after
it, as flat arrays ``x`` (inputs) and ``y`` (targets), row after row, that begin with the rows ``first_x`` and ``first_y`` of
the series. Samples are places in a block: ``low <= sample_id < high``, where sample *i* reads the input rows
``i+1 .. i+window`` and the target rows after them. With the default layout a block holds about a tenth more rows than its
chunk, whereas a table of samples holds every row ``window + horizon`` times.

``begin`` and ``end`` bound the samples that are meant, of a split or of the whole series; a block at such a bound has
``low = begin`` or ``high = end``. Series without a full sample have no blocks. A null in an array is a missing value.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans import Layout, spread
from .clean import require_columns
from .prepare import SPLITS, TARGETS, fraction_bounds

BLOCK_COLUMNS = ["symbol", "n", "samples", "low", "high", "begin", "end", "first_x", "x", "first_y", "y"]


def _row(columns: Sequence[str]) -> str:
    return "array(" + ", ".join(f"cast(`{c}` as double)" for c in columns) + ")"


def sequence_blocks(
    df: DataFrame,
    columns: Sequence[str],
    window: int,
    horizon: int,
    targets: Sequence[str] | None = None,
    layout: Layout = Layout(),
) -> DataFrame:
    """The blocks of rows with ``symbol``, ``rn`` and ``n``; one exchange, and no group larger than a chunk and its halo."""
    targets = list(targets or TARGETS)
    rows = spread(
        require_columns(df, ["symbol", "rn", "n", *columns, *targets]), layout, back=window - 1, ahead=horizon
    )
    size = layout.chunk_rows
    gathered = rows.selectExpr(
        "symbol", "n", "_chunk", f"struct(rn, {_row(columns)} as x, {_row(targets)} as y) as r"
    ).groupBy("symbol", "n", "_chunk").agg({"r": "collect_list"})
    return gathered.selectExpr(
        "symbol",
        "n",
        f"n - {window} - {horizon} + 1 as samples",
        f"greatest(0L, _chunk * {size} + 1 - {window}) as low",
        f"least(n - {horizon}, (_chunk + 1) * {size}) - {window} + 1 as high",
        "sort_array(`collect_list(r)`) as r",
    ).filter("low < high").selectExpr(
        "symbol", "n", "samples", "low", "high", "0L as begin", "samples as end",
        "r[0].rn as first_x", "flatten(r.x) as x", "r[0].rn as first_y", "flatten(r.y) as y",
    )


def blocks_of_samples(samples: DataFrame) -> DataFrame:
    """A block for each row of ``prepare.sequences``: for small sets of samples that are already written out."""
    return samples.selectExpr(
        "symbol", "n", "samples", "sample_id as low", "sample_id + 1 as high", "sample_id as begin", "sample_id + 1 as end",
        "sample_id + 1 as first_x", "flatten(x) as x", "sample_id + size(x) + 1 as first_y", "y",
    )


def of_split(blocks: DataFrame, split: str, bounds: tuple[str, str] | None = None) -> DataFrame:
    """The blocks with samples of a split, and its bounds. No shuffle, and no row is written twice.

    ``bounds`` are those of ``prepare.fraction_bounds`` (default) or ``prepare.ceil_bounds``.
    """
    first, second = bounds or fraction_bounds()
    begin, end = dict(zip(SPLITS, (("0L", first), (first, second), (second, "samples"))))[split]
    kept = [c for c in BLOCK_COLUMNS if c not in ("low", "high", "begin", "end")]
    return blocks.selectExpr(
        *kept, f"greatest(low, {begin}) as low", f"least(high, {end}) as high", f"{begin} as begin", f"{end} as end"
    ).filter("low < high").select(*BLOCK_COLUMNS)


def samples_of(blocks: DataFrame, window: int, horizon: int, inputs: int, outputs: int = len(TARGETS)) -> DataFrame:
    """The samples written out as by ``prepare.sequences``; ``inputs`` and ``outputs`` are the numbers of columns."""
    x = f"transform(sequence(0, {window - 1}), j -> slice(x, cast((sample_id + 1 - first_x + j) * {inputs} + 1 as int), {inputs}))"
    y = f"slice(y, cast((sample_id + {window} + 1 - first_y) * {outputs} + 1 as int), {horizon * outputs})"
    return blocks.selectExpr("*", "explode(sequence(low, high - 1)) as sample_id").selectExpr(
        "symbol", f"sample_id + {window} as rn", "n", "sample_id", "samples", f"{x} as x", f"{y} as y"
    )


class Block(NamedTuple):
    """A block in a task: the inputs from its first sample's first row on, and the targets from that sample's first on."""

    symbol: str
    n: int
    low: int
    high: int
    begins: bool
    ends: bool
    x: np.ndarray
    y: np.ndarray

    def windows(self, window: int) -> np.ndarray:
        """A row for each sample: its window, flattened."""
        m, c = self.high - self.low, self.x.shape[1]
        view = np.lib.stride_tricks.sliding_window_view(self.x[: m + window - 1], window, axis=0)
        return view.transpose(0, 2, 1).reshape(m, window * c)

    def targets(self, horizon: int) -> np.ndarray:
        m, c = self.high - self.low, self.y.shape[1]
        view = np.lib.stride_tricks.sliding_window_view(self.y[: m + horizon - 1], horizon, axis=0)
        return view.transpose(0, 2, 1).reshape(m, horizon * c)


def in_batches(batches: Iterator[pa.RecordBatch], window: int, inputs: int, outputs: int) -> Iterator[Block]:
    """The blocks of Arrow batches; their arrays are views of the batch where nothing is missing."""
    for batch in batches:
        names = batch.schema.names
        column = {c: batch.column(names.index(c)) for c in BLOCK_COLUMNS}
        values = {c: (column[c].values.to_numpy(zero_copy_only=False), column[c].offsets.to_numpy()) for c in ("x", "y")}
        scalar = {c: column[c].to_pylist() for c in BLOCK_COLUMNS if c not in values}
        for i in range(batch.num_rows):
            low, high = scalar["low"][i], scalar["high"][i]
            own = {}
            for c, width, before in (("x", inputs, 1), ("y", outputs, window + 1)):
                flat, offsets = values[c]
                rows = flat[offsets[i] : offsets[i + 1]].reshape(-1, width)
                own[c] = rows[low + before - scalar[f"first_{c}"][i] :]
            yield Block(
                scalar["symbol"][i], scalar["n"][i], low, high, low == scalar["begin"][i], high == scalar["end"][i],
                own["x"], own["y"],
            )
