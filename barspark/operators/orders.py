"""Lot size, order intents from zones, and reconciliation of tracked orders."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans import Layout, chunk_sql, join_salted, running_max
from .zones import ZONE_COLUMNS

# Fixed value: share of the balance risked per trade, in percent.
RISK_PERCENT = 0.423

SYMBOL_INFO = ("point", "tick_value", "tick_size", "lot_min", "lot_max", "lot_step")


def lot_sql(entry: str, sl: str, balance: str, risk_percent: float) -> str:
    """Lots that lose the risked amount at the stop, on the lot grid and inside its limits.

    A stop nearer than half a point is a degenerate zone: its lot has no finite value and is the
    largest allowed.
    """
    pips = f"(abs({entry} - {sl}) / point)"
    pip_value = "(tick_value * point / tick_size)"
    lots = f"floor({balance} * ({risk_percent!r}D / 100) / ({pips} * {pip_value}) / lot_step) * lot_step"
    return (
        f"case when {degenerate_sql(entry, sl)} then lot_max "
        f"else greatest(lot_min, least(lot_max, {lots})) end"
    )


def degenerate_sql(entry: str, sl: str) -> str:
    return f"abs({entry} - {sl}) < point / 2"


def size_positions(
    signals: DataFrame,
    symbol_info: DataFrame,
    balance: str = "balance",
    risk_percent: float = RISK_PERCENT,
) -> DataFrame:
    """Add ``lot`` and ``degenerate`` to rows with ``symbol, ts, entry, sl``.

    ``balance`` is the SQL of the account balance: a column of ``signals`` or a literal.
    """
    info = symbol_info.select("symbol", *SYMBOL_INFO)
    return join_salted(signals, info, ["symbol"], "ts").selectExpr(
        *[f"`{c}`" for c in signals.columns],
        f"{degenerate_sql('entry', 'sl')} as degenerate",
        f"{lot_sql('entry', 'sl', balance, risk_percent)} as lot",
    )


def order_intents(
    zones: DataFrame,
    symbol_info: DataFrame,
    balance: str,
    risk_percent: float = RISK_PERCENT,
    layout: Layout = Layout(),
) -> DataFrame:
    """Sell-limit and buy-limit intents, one row per attempt.

    ``zones`` is the result of ``detect_zones`` on bars that carry the quote at the bar's first tick as
    ``bid`` and ``ask``. A sell is skipped when the ask is already below the entry, a buy when the bid
    is above it. A skipped sell ends the bar: the demand zone then waits for the first later bar that is
    not ended this way, and a newer demand zone replaces it. Lot limits must be positive.
    """
    info = symbol_info.select("symbol", *SYMBOL_INFO)
    rows = join_salted(zones, info, ["symbol"], "rn").selectExpr(
        *[f"`{c}`" for c in zones.columns],
        *[
            f"{lot_sql(f'{k}_entry', f'{k}_sl', balance, risk_percent)} as {k}_lot"
            for k in ("supply", "demand")
        ],
        *[f"{degenerate_sql(f'{k}_entry', f'{k}_sl')} as {k}_degenerate" for k in ("supply", "demand")],
        "coalesce(ask < supply_entry, false) as _ended",
        f"{chunk_sql(layout)} as _chunk",
    )
    fields = (*ZONE_COLUMNS, "lot", "degenerate")

    def struct(kind: str) -> str:
        return ", ".join(f"'{c}', {kind}_{c}" for c in fields)

    rows = running_max(
        rows,
        {
            "_open_bar": "case when not _ended then rn end",
            "_waiting": "case when demand_zone_ts is not null "
            f"then named_struct('rn', rn, {struct('demand')}) end",
        },
        layout,
        strict=frozenset({"_open_bar"}),
    )
    sell = (
        "case when supply_zone_ts is not null and supply_lot > 0 then named_struct("
        "'side', 'SELL_LIMIT', 'action', case when _ended then 'SKIP' else 'PLACE' end, "
        f"{struct('supply')}) end"
    )
    # detected after the last bar that let demand through, hence not attempted yet
    due = "not _ended and _waiting.rn > coalesce(_open_bar, 0) and _waiting.lot > 0"
    buy = (
        f"case when {due} then named_struct("
        "'side', 'BUY_LIMIT', 'action', case when bid > _waiting.entry then 'SKIP' else 'PLACE' end, "
        + ", ".join(f"'{c}', _waiting.{c}" for c in fields)
        + ") end"
    )
    return rows.selectExpr(
        "symbol", "ts", "bid", "ask", f"explode(array_compact(array({sell}, {buy}))) as _o"
    ).selectExpr("symbol", "ts", "bid", "ask", "_o.*")


def stale_tickets(tracked: DataFrame, open_orders: DataFrame) -> DataFrame:
    """Tracked tickets (> 0) that are no longer among the open orders; their zone is to be reset."""
    return tracked.filter("ticket > 0").join(open_orders.select("ticket"), "ticket", "left_anti")


def live_tickets(tracked: DataFrame, open_orders: DataFrame) -> DataFrame:
    return tracked.filter("ticket > 0").join(open_orders.select("ticket"), "ticket", "left_semi")


def reset_zones(tracked: DataFrame, open_orders: DataFrame) -> DataFrame:
    """Every tracked zone after reconciliation: ticket 0 and not valid where the order is gone."""
    present = open_orders.selectExpr("ticket", "true as _present").dropDuplicates(["ticket"])
    gone = "(ticket > 0 and _present is null)"
    rest = [f"`{c}`" for c in tracked.columns if c != "ticket"]
    return tracked.join(present, "ticket", "left").selectExpr(
        *rest,
        f"case when {gone} then 0 else ticket end as ticket",
        f"not {gone} and ticket > 0 as valid",
    )
