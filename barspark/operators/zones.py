"""Supply and demand zones.

At the start of bar *t* the closes of the ``lookback`` bars before it are searched. Supply forms at the
highest close when that candle and the one before it are bullish, demand at the lowest close when both
are bearish. The most recent bar wins a tie.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..plans import Layout, chunk_sql, number_rows, over, running_max, settle, spread

LOOKBACK = 100
ZONE_COLUMNS = ("zone_ts", "upper", "lower", "entry", "sl", "tp")


@dataclass(frozen=True)
class ZoneLevels:
    """Entry and stop as fractions of the zone height, target as a multiple of the risk.

    With the default fractions entry and stop are the same price up to rounding, because
    ``high - 0.618 h`` and ``low + 0.382 h`` coincide; ``sl=0.618`` moves the stop beyond the entry.
    """

    entry: float = 0.618
    sl: float = 0.382
    reward: float = 1.5


# Numeric codes of the zone types.
ZONE_TYPES = {"SUPPLY": 1, "DEMAND": 2}


def rolling(rows: DataFrame, exprs: dict[str, tuple[str, str]], size: int) -> DataFrame:
    """Add the ``max`` or ``min`` of each expression over the ``size`` rows before a row (``rows`` as from ``spread``).

    Positions are cut into blocks of ``size``. Any ``size`` consecutive rows are the end of one block and the beginning
    of the next, so that their extremum is that of two running ones, from the block's end backward and from its beginning
    forward. The work for a row does not depend on ``size``. The chunk must hold the ``size`` rows before a home row.
    """
    block = rows.selectExpr("*", f"floor((rn - 1) / {size}) as _block")
    running = []
    for name, (fn, expr) in exprs.items():
        for way, order in (("f", "rn"), ("b", "rn desc")):
            frame = f"partition by symbol, _chunk, _block order by {order} rows between unbounded preceding and current row"
            running.append(f"{fn}({expr}) over ({frame}) as _{way}{name}")
    pick = {"max": "greatest", "min": "least"}
    both = [
        f"{pick[fn]}({over(f'lag(_f{name})')}, {over(f'lag(_b{name}, {size})')}) as {name}" for name, (fn, _) in exprs.items()
    ]
    kept = [f"`{c}`" for c in rows.columns]
    return block.selectExpr(*kept, "_block", *running).selectExpr(*kept, *both)


def _extremes(bars: DataFrame, layout: Layout, lookback: int) -> DataFrame:
    rows = spread(number_rows(bars, layout), layout, back=lookback + 2)
    before = {c: over(f"lag({c})") for c in ("open", "high", "low", "close")}
    rows = rows.selectExpr("*", *[f"{sql} as _p_{c}" for c, sql in before.items()])
    candle = (
        "'rn', rn, 'ts', ts, 'open', open, 'high', high, 'low', low, "
        "'p_open', _p_open, 'p_high', _p_high, 'p_low', _p_low, 'p_close', _p_close"
    )
    # a close of 0 or less never beats the starting value of the search for the highest
    highest = f"case when close > 0 then named_struct('close', close, {candle}) end"
    lowest = f"named_struct('close', close, 'age', -rn, {candle})"
    rows = rolling(rows, {"_hi": ("max", highest), "_lo": ("min", lowest)}, lookback)
    # the lowest close needs a full look-back: an absent bar reads as price 0 and would win
    return rows.selectExpr(
        *[f"`{c}`" for c in rows.columns if c != "_lo"], f"case when rn > {lookback} then _lo end as _lo"
    )


def extreme_closes(
    bars: DataFrame, lookback: int = LOOKBACK, layout: Layout = Layout()
) -> DataFrame:
    """Highest and lowest close of the previous bars and how many bars back they are."""
    return settle(_extremes(bars, layout, lookback)).selectExpr(
        "symbol",
        "ts",
        "_hi.close as highest_close",
        "rn - _hi.rn as highest_shift",
        "_lo.close as lowest_close",
        "rn - _lo.rn as lowest_shift",
    )


def candle_pairs(bars: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Whether a candle and the one before it are both bullish or both bearish."""
    rows = spread(number_rows(bars, layout), layout, back=1)
    o, c = over("lag(open)"), over("lag(close)")
    return settle(
        rows.selectExpr(
            "*",
            f"coalesce(close > open and {c} > {o}, false) as both_bullish",
            f"coalesce(close < open and {c} < {o}, false) as both_bearish",
        )
    ).drop("_chunk")


def detect_zones(
    bars: DataFrame,
    lookback: int = LOOKBACK,
    levels: ZoneLevels = ZoneLevels(),
    layout: Layout = Layout(),
) -> DataFrame:
    """One row per bar: its columns, ``supply_*`` and ``demand_*`` levels (NULL = none detected).

    ``*_first`` marks the first bar that detects a zone; the same extremum is detected again on each
    later bar while it stays in the look-back.
    """
    e, s, r = (f"{float(x)!r}D" for x in (levels.entry, levels.sl, levels.reward))
    rows = _extremes(bars, layout, lookback).selectExpr(
        *[f"`{c}`" for c in bars.columns if c not in ("rn", "n")],
        "rn",
        "n",
        "_chunk",
        "_home",
        "case when _hi.close > _hi.open and _hi.p_close > _hi.p_open then _hi end as _s",
        "case when _lo.close < _lo.open and _lo.p_close < _lo.p_open then _lo end as _d",
    )
    rows = rows.selectExpr(
        "*",
        "_s.ts as supply_zone_ts",
        "_s.high as supply_upper",
        f"_s.high - (_s.high - _s.p_low) * {e} as supply_lower",
        f"_s.high - (_s.high - _s.p_low) * {e} as supply_entry",
        f"_s.p_low + (_s.high - _s.p_low) * {s} as supply_sl",
        "_d.ts as demand_zone_ts",
        f"_d.low + (_d.p_high - _d.low) * {e} as demand_upper",
        "_d.low as demand_lower",
        f"_d.low + (_d.p_high - _d.low) * {e} as demand_entry",
        f"_d.p_high - (_d.p_high - _d.low) * {s} as demand_sl",
    )
    rows = rows.selectExpr(
        "*",
        f"supply_entry - abs(supply_entry - supply_sl) * {r} as supply_tp",
        f"demand_entry + abs(demand_entry - demand_sl) * {r} as demand_tp",
        *[
            f"{z}_zone_ts is not null and not ({over(f'lag({z}_zone_ts)')} <=> {z}_zone_ts) as {z}_first"
            for z in ("supply", "demand")
        ],
    )
    return settle(rows).drop("_s", "_d", "_chunk")


def zone_rows(zones: DataFrame) -> DataFrame:
    """Detected zones in long form: one row per bar and zone type."""

    def zone(kind: str) -> str:
        fields = ", ".join(f"'{c}', {kind}_{c}" for c in ZONE_COLUMNS)
        return (
            f"case when {kind}_zone_ts is not null then named_struct('type', '{kind.upper()}', "
            f"'code', {ZONE_TYPES[kind.upper()]}, {fields}, 'first', {kind}_first) end"
        )

    both = f"explode(array_compact(array({zone('supply')}, {zone('demand')}))) as _z"
    return zones.selectExpr("symbol", "ts", both).selectExpr("symbol", "ts", "_z.*")


def last_zones(zones: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Carry the latest zone of each type forward; NULL before the first one (not valid yet)."""
    rows = zones.selectExpr("*", f"{chunk_sql(layout)} as _chunk")

    def latest(kind: str) -> str:
        fields = ", ".join(f"'{c}', {kind}_{c}" for c in ZONE_COLUMNS)
        return f"case when {kind}_zone_ts is not null then named_struct('rn', rn, 'ts', ts, {fields}) end"

    carried = running_max(rows, {f"last_{k}": latest(k) for k in ("supply", "demand")}, layout)
    return carried.drop("_chunk")
