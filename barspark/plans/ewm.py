"""Exponentially weighted means as a prefix scan.

``y_t = (1-alpha) * y_{t-1} + alpha * x_t`` is an affine map of the value before it. Affine maps
compose associatively, so each chunk is scanned on its own with window sums and one small summary per
chunk travels between chunks. The result equals the recursive form started at the first value
(``adjust=False``); a missing input repeats the last mean and its weight keeps decaying.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .layout import Layout
from .series import chunk_end_sql, earlier, so_far
from .stage import stage

# A summary of consecutive rows: r, x = position and value of the first input, mean at the end =
# a * (mean at r) + b, l = position of the last input. All NULL where there is no input.
_PARTS = ("r", "x", "a", "b", "l")


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1.0)


def ewm(
    df: DataFrame, specs: dict[str, tuple[str, float]], layout: Layout, carry: bool = True
) -> DataFrame:
    """Add ``{out: (input column, alpha)}`` to chunked, settled rows (``symbol, _chunk, rn, n``).

    Runs one job at once: the chunk summaries are worked out and stored before the result is returned.
    With ``carry=False`` every chunk is a series of its own and no job runs.
    """
    for out, (_, alpha) in specs.items():
        if not 0.0 < alpha < 1.0:
            raise ValueError(f"{out}: alpha must lie between 0 and 1")
        # the scan divides by (1-alpha)^rows, which must stay inside the range of a double
        if -math.log1p(-alpha) * layout.chunk_rows > 650.0:
            most = int(650 / -math.log1p(-alpha))
            raise ValueError(f"{out}: alpha {alpha} needs chunk_rows <= {most}")

    inputs = sorted({c for c, _ in specs.values()})

    def scanned(df: DataFrame) -> DataFrame:
        seen = df.selectExpr(
            "*",
            *[
                part
                for c in inputs
                for part in (
                    f"rn - {earlier(f'max(case when {c} is not null then rn end)')} as _gap_{c}",
                    f"{so_far(f'min(case when {c} is not null then rn end)')} as _r_{c}",
                    f"{so_far(f'first({c}, true)')} as _x_{c}",
                )
            ],
        )
        scaled = seen.selectExpr(
            "*", *[f"exp(coalesce({so_far(_log_factor_sum(c, a))}, 0D)) as _a_{o}" for o, (c, a) in specs.items()]
        )
        return scaled.selectExpr(
            "*", *[f"coalesce({so_far(_shift_sum(o, c, a))}, 0D) as _s_{o}" for o, (c, a) in specs.items()]
        )

    summed = scanned(df)
    if not carry:
        return summed.selectExpr(
            *[f"`{c}`" for c in df.columns],
            *[f"case when _r_{c} is not null then _a_{o} * (_x_{c} + _s_{o}) end as {o}" for o, (c, _) in specs.items()],
        )
    # the chunk ends need the inputs alone; nothing but their summaries is written
    ends = scanned(df.select("symbol", "_chunk", "rn", "n", *inputs)).filter(chunk_end_sql(layout)).selectExpr(
        "symbol",
        "_chunk",
        *[
            part
            for o, (c, _) in specs.items()
            for part in (
                f"cast(_r_{c} as double) as r_{o}",
                f"_x_{c} as x_{o}",
                f"_a_{o} as a_{o}",
                f"_a_{o} * _s_{o} as b_{o}",
                # the last input at or before the end of the chunk
                f"cast(case when {c} is not null then rn else rn - _gap_{c} end as double) as l_{o}",
            )
        ],
    )
    carried = _carry(ends, {o: a for o, (_, a) in specs.items()}, layout)
    return summed.join(carried, ["symbol", "_chunk"]).selectExpr(
        *[f"`{c}`" for c in df.columns], *[f"{_value(o, c, a)} as {o}" for o, (c, a) in specs.items()]
    )


def _keep(gap: str, alpha: float) -> str:
    """Weight left on the old mean ``gap`` rows after its last input."""
    keep = 1.0 - alpha
    return f"(case when {gap} = 1 then {keep!r}D else pow({keep!r}D, {gap}) end)"


def _log_factor_sum(c: str, alpha: float) -> str:
    keep = _keep(f"_gap_{c}", alpha)
    return (
        f"sum(case when {c} is null or _gap_{c} is null then null "
        f"when _gap_{c} = 1 then {math.log1p(-alpha)!r}D else ln({keep} / ({keep} + {alpha!r}D)) end)"
    )


def _shift_sum(out: str, c: str, alpha: float) -> str:
    return (
        f"sum(case when {c} is not null and _gap_{c} is not null "
        f"then {alpha!r}D * {c} / ({_keep(f'_gap_{c}', alpha)} + {alpha!r}D) / _a_{out} end)"
    )


def _value(out: str, c: str, alpha: float) -> str:
    """Mean at a row from the chunk's own sums and the mean ``y`` carried in from position ``l``."""
    keep = f"pow({1.0 - alpha!r}D, _r_{c} - l_{out})"
    start = (
        f"case when y_{out} is null then _x_{c} "
        f"else ({keep} * y_{out} + {alpha!r}D * _x_{c}) / ({keep} + {alpha!r}D) end"
    )
    return f"case when _r_{c} is null then y_{out} else _a_{out} * ({start} + _s_{out}) end"


def _carry(ends: DataFrame, alphas: dict[str, float], layout: Layout) -> DataFrame:
    """Mean ``y_*`` and position ``l_*`` of the last input before each chunk.

    Two levels: ``fanout`` neighbouring chunks are composed per group, then the group totals per
    symbol, so the largest group is the larger of ``fanout`` and rows / (chunk_rows * fanout). The
    second level is left out where every symbol fits in one group.
    """
    outs = list(alphas)
    parts = [f"{p}_{o}" for o in outs for p in _PARTS]
    alpha = np.array([alphas[o] for o in outs])
    columns = ", ".join(f"{c} double" for c in parts)
    grouped = ends.selectExpr("*", f"floor(_chunk / {layout.fanout}) as _group")

    def compose_group(pdf: pd.DataFrame) -> pd.DataFrame:
        before, total = _scan(pdf.sort_values("_chunk")[parts].to_numpy(float), alpha)
        result = pd.DataFrame(np.vstack([before, total]), columns=parts)
        result["symbol"] = pdf["symbol"].iloc[0]
        result["_group"] = pdf["_group"].iloc[0]
        result["_chunk"] = [*np.sort(pdf["_chunk"].to_numpy()), -1]
        return result

    def compose_totals(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_group")
        before, _ = _scan(pdf[parts].to_numpy(float), alpha)
        result = pd.DataFrame(before, columns=parts)
        result["symbol"], result["_group"] = pdf["symbol"].to_numpy(), pdf["_group"].to_numpy()
        return result

    scanned = stage(
        grouped.groupBy("symbol", "_group").applyInPandas(
            compose_group, f"symbol string, _group bigint, _chunk bigint, {columns}"
        ),
        "carry",
    )
    chunks = scanned.filter("_chunk >= 0")
    if scanned.filter("_group > 0").isEmpty():
        return chunks.selectExpr(
            "symbol",
            "_chunk",
            *[part for o in outs for part in (f"a_{o} * x_{o} + b_{o} as y_{o}", f"l_{o}")],
        )
    totals = (
        scanned.filter("_chunk = -1")
        .groupBy("symbol")
        .applyInPandas(compose_totals, f"symbol string, _group bigint, {columns}")
        .selectExpr(
            "symbol",
            "_group",
            *[p for o in outs for p in (f"a_{o} * x_{o} + b_{o} as y_{o}", f"l_{o} as p_{o}")],
        )
    )
    # a group's own prefix, applied to the mean that enters the group
    return chunks.join(totals, ["symbol", "_group"]).selectExpr(
        "symbol",
        "_chunk",
        *[
            part
            for o in outs
            for part in (
                f"case when r_{o} is null then y_{o} else a_{o} * ({_enter(o, alphas[o])}) + b_{o} end as y_{o}",
                f"coalesce(l_{o}, p_{o}) as l_{o}",
            )
        ],
    )


def _enter(o: str, alpha: float) -> str:
    keep = f"pow({1.0 - alpha!r}D, r_{o} - p_{o})"
    return (
        f"case when y_{o} is null then x_{o} "
        f"else ({keep} * y_{o} + {alpha!r}D * x_{o}) / ({keep} + {alpha!r}D) end"
    )


def _scan(rows: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exclusive compositions of summaries in time order, and the composition of all of them."""
    cube = rows.reshape(len(rows), len(alpha), len(_PARTS))
    before = np.empty_like(cube)
    state = np.full(cube.shape[1:], np.nan)
    for i, part in enumerate(cube):
        before[i] = state
        keep = (1.0 - alpha) ** (part[:, 0] - state[:, 4])
        grow, shift = keep / (keep + alpha), alpha * part[:, 1] / (keep + alpha)
        joined = np.column_stack(
            [
                state[:, 0],
                state[:, 1],
                part[:, 2] * grow * state[:, 2],
                part[:, 2] * (grow * state[:, 3] + shift) + part[:, 3],
                part[:, 4],
            ]
        )
        no_part, no_state = np.isnan(part[:, :1]), np.isnan(state[:, :1])
        state = np.where(no_part, state, np.where(no_state, part, joined))
    return before.reshape(len(rows), -1), state.reshape(1, -1)
