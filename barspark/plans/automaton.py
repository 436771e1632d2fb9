"""The state of a small automaton before each row, as a prefix scan.

Every row is a function from ``STATES`` states to as many. Functions compose associatively, so that each chunk is
composed on its own and one function per chunk travels on: ``fanout`` neighbouring chunks are composed per group, then
the groups of a symbol, of which there is one for 4.2 million rows with the default layout.

A function is one number, in base ``STATES`` with the digit of state *s* at place *s*. There are 256 of them, and a table
of their compositions makes a step of the scan one look-up.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .layout import Layout

STATES = 4


def encode(after: Iterable[int]) -> int:
    """The number of a function, given the state after each state."""
    return sum(s * STATES**place for place, s in enumerate(after))


IDENTITY = encode(range(STATES))


def _compositions() -> np.ndarray:
    """Row *f*, column *g*: the number of "*f*, then *g*"."""
    codes = np.arange(STATES**STATES)
    digits = codes[:, None] // STATES ** np.arange(STATES) % STATES
    both = digits[codes[None, :, None], digits[:, None, :]]  # [f, g, s] = g(f(s))
    return (both * STATES ** np.arange(STATES)).sum(axis=2)


THEN = _compositions().tolist()


def _scan(codes: list[int]) -> tuple[list[int], int]:
    """The composition of all earlier functions at each place, and that of all."""
    before, done = [], IDENTITY
    for code in codes:
        before.append(done)
        done = THEN[done][code]
    return before, done


def scan_states(df: DataFrame, code: str, layout: Layout, start: int = 0, out: str = "state") -> DataFrame:
    """Add ``out``, the state before each row of its series, to chunked rows (``symbol, _chunk, rn``).

    ``code`` is SQL for the number of the row's function (see ``encode``); NULL leaves the state. ``df`` is read twice.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_prefix", T.IntegerType())])
    coded = df.selectExpr("*", f"cast(coalesce({code}, {IDENTITY}) as int) as _prefix")

    def inside(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table["rn"].to_numpy(), kind="stable")))
        before, _ = _scan(table["_prefix"].to_pylist())
        return table.set_column(table.num_columns - 1, "_prefix", pa.array(before, pa.int32()))

    rows = coded.groupBy("symbol", "_chunk").applyInArrow(inside, schema)
    return rows.join(_before(coded, layout), ["symbol", "_chunk"]).selectExpr(
        *[f"`{c}`" for c in df.columns], f"{_apply('_prefix', _apply('_earlier', str(start)))} as {out}"
    )


def _apply(code: str, state: str) -> str:
    """SQL of the state that a function makes of a state."""
    return f"cast(shiftright({code}, 2 * ({state})) & {STATES - 1} as int)"


def _before(coded: DataFrame, layout: Layout) -> DataFrame:
    """``_earlier``: the composition of all chunks before each chunk."""
    narrow = coded.select("symbol", "_chunk", "rn", "_prefix")

    def total(table: pa.Table) -> pa.Table:
        order = np.argsort(table["rn"].to_numpy(), kind="stable")
        done = _scan(table["_prefix"].to_numpy()[order].tolist())[1]
        return pa.table({"symbol": table["symbol"][:1], "_chunk": table["_chunk"][:1], "_total": pa.array([done], pa.int32())})

    def group(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table["_chunk"].to_numpy(), kind="stable")))
        before, done = _scan(table["_total"].to_pylist())
        n = len(before)
        return pa.table(
            {
                "symbol": table["symbol"], "_chunk": table["_chunk"], "_group": table["_group"],
                "_inner": pa.array(before, pa.int32()), "_total": pa.array([None] * (n - 1) + [done], pa.int32()),
            }
        )

    def groups(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table["_group"].to_numpy(), kind="stable")))
        before, _ = _scan(table["_total"].to_pylist())
        return pa.table({"symbol": table["symbol"], "_group": table["_group"], "_outer": pa.array(before, pa.int32())})

    key = "symbol string, "
    totals = narrow.groupBy("symbol", "_chunk").applyInArrow(total, key + "_chunk bigint, _total int")
    grouped = totals.selectExpr("*", f"floor(_chunk / {layout.fanout}) as _group").groupBy("symbol", "_group")
    inner = grouped.applyInArrow(group, key + "_chunk bigint, _group bigint, _inner int, _total int")
    outer = inner.where("_total is not null").groupBy("symbol").applyInArrow(groups, key + "_group bigint, _outer int")
    composed = " | ".join(
        f"shiftleft({_apply('_inner', _apply('_outer', str(s)))}, {2 * s})" for s in range(STATES)
    )
    return inner.join(outer, ["symbol", "_group"]).selectExpr("symbol", "_chunk", f"{composed} as _earlier")
