"""Orders with their state: what becomes of every zone when the broker's answers are known.

A symbol tracks the latest zone of each type and the ticket of each type's order. At a bar, in this order:

1. A check made since the bar before finds an order gone: its ticket is 0 and the zone of its type no longer valid,
   whether or not a newer zone has replaced the one that the order was placed for. Without a ticket nothing happens.
2. A detected zone replaces the one before and is unused, also where it is the same extremum again.
3. A valid, unused supply zone with a lot above 0 is attempted. With the ask below the entry it is skipped and used, and
   the bar ends. Otherwise the order is placed (ticket, zone used) or rejected, and the zone then waits for the next bar.
4. The demand zone likewise, with the bid above the entry, unless the bar has ended.

This is a walk from bar to bar, done here as prefix scans. Without resets a zone is open until its first bar at which it
is skipped or placed: running maxima carry the zone and the last such bar. Whether a reset hits depends on two bits, zone
valid and ticket there; every bar is a function of them, and functions compose (see ``plans.automaton``). Supply does not
look at demand and is worked out first; the bars that it ends are then known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans import Layout, chunk_sql, join_salted, number_rows, running_max, stage
from ..plans.automaton import encode, scan_states
from .orders import RISK_PERCENT, SYMBOL_INFO, degenerate_sql, lot_sql
from .zones import ZONE_COLUMNS, ZONE_TYPES

KINDS = tuple(k.lower() for k in ZONE_TYPES)
SIDES = {"supply": "SELL_LIMIT", "demand": "BUY_LIMIT"}
#: The broker's answers in a status feed.
REJECTED, GONE = "REJECTED", "GONE"
VALID, TICKET = 1, 2


def bar_function(gone: bool, detected: bool, placed: bool) -> int:
    """What a bar makes of the two bits, as a number: reset, detection and placement in turn."""

    def after(state: int) -> int:
        valid, ticket = state & VALID, state & TICKET
        if gone and ticket:
            valid = ticket = 0
        if detected:
            valid = VALID
        if placed and valid:
            ticket = TICKET
        return valid | ticket

    return encode(map(after, range(4)))


_FUNCTIONS = "array(" + ", ".join(str(bar_function(i & 1, i & 2, i & 4)) for i in range(8)) + ")"


def mark_status(bars: DataFrame, status: DataFrame | None, layout: Layout = Layout()) -> DataFrame:
    """Add ``<type>_rejected`` and ``<type>_gone`` to bars with ``symbol`` and ``ts``.

    ``status`` has ``symbol, ts, type, event``. ``REJECTED`` refers to the bar of that time. ``GONE`` is a check that found no
    order, and counts for the first bar at or after it. Rows of other events, and checks after the last bar, are ignored.
    """
    names = [f"{k}_{e}" for e in ("rejected", "gone") for k in KINDS]
    if status is None:
        return bars.selectExpr("*", *[f"false as {c}" for c in names])

    def flags(event: str) -> list:
        return [
            F.coalesce(F.max(F.expr(f"type = '{k.upper()}' and event = '{event}'")), F.lit(False)).alias(f"_{k}") for k in KINDS
        ]

    by_time = status.groupBy("symbol", "ts")
    rejected = by_time.agg(*flags(REJECTED)).selectExpr("symbol", "ts", *[f"_{k} as {k}_rejected" for k in KINDS])
    checks = by_time.agg(*flags(GONE)).filter(" or ".join(f"_{k}" for k in KINDS))
    # checks and bars are numbered together, a check before the bar of the same time
    kept = [c for c in bars.columns if c not in ("rn", "n")]
    own = [c for c in ("rn", "n") if c in bars.columns]
    both = bars.selectExpr("*", "1 as _kind").withColumnsRenamed({c: f"_{c}" for c in own}).unionByName(
        checks.selectExpr("*", "0 as _kind"), allowMissingColumns=True
    )
    rows = number_rows(both, layout, tie=("_kind",)).selectExpr("*", f"{chunk_sql(layout)} as _chunk")
    last = {f"_last_{k}": f"case when _kind = 0 and _{k} then rn end" for k in KINDS}
    last["_bar"] = "case when _kind = 1 then rn end"
    rows = running_max(rows, last, layout, strict=frozenset(last)).filter("_kind = 1")
    rows = rows.selectExpr(
        *[f"`{c}`" for c in kept], *[f"_{c} as {c}" for c in own],
        *[f"coalesce(_last_{k} > coalesce(_bar, 0), false) as {k}_gone" for k in KINDS],
    )
    return rows.join(rejected, ["symbol", "ts"], "left").na.fill(False, [f"{k}_rejected" for k in KINDS])


def _attempts(rows: DataFrame, kind: str, balance: str, risk_percent: float, layout: Layout) -> DataFrame:
    """Add ``_<kind>``: the zone at each bar, with ``action`` (NULL: nothing tried), and ``lost``, a zone that was reset."""
    columns = [f"`{c}`" for c in rows.columns]
    fields = ", ".join(f"'{c}', {kind}_{c}" for c in ZONE_COLUMNS)
    zone = f"case when {kind}_zone_ts is not null then named_struct('rn', rn, {fields}) end"
    rows = running_max(rows, {"_z": zone, "_before": zone}, layout, strict=frozenset({"_before"}))
    rows = rows.selectExpr("*", f"{lot_sql('_z.entry', '_z.sl', balance, risk_percent)} as _lot")
    ended = " and not coalesce(_supply.action = 'SKIP', false)" if kind == "demand" else ""
    passed = "ask < _z.entry" if kind == "supply" else "bid > _z.entry"
    rows = rows.selectExpr("*", f"coalesce(_lot > 0, false){ended} as _can", f"coalesce({passed}, false) as _passed")
    used = f"case when _can and (_passed or not {kind}_rejected) then rn end"
    rows = running_max(rows, {"_used": used}, layout, strict=frozenset({"_used"}))
    # as if there were no resets
    tried = (
        "case when not _can or coalesce(_used, 0) >= _z.rn then null when _passed then 'SKIP' "
        f"when {kind}_rejected then 'REJECT' else 'PLACE' end"
    )
    rows = rows.selectExpr("*", f"{tried} as _tried")
    code = f"{_FUNCTIONS}[int({kind}_gone) + 2 * int({kind}_zone_ts is not null) + 4 * int(coalesce(_tried = 'PLACE', false))]"
    rows = scan_states(rows, code, layout, out="_state")
    reset = f"{kind}_gone and _state >= {TICKET}"
    valid = f"({kind}_zone_ts is not null or (_state % 2 = {VALID} and not ({reset})))"
    values = ", ".join(f"'{c}', _z.{c}" for c in ZONE_COLUMNS)
    lost = f"case when {reset} then _before end"
    return rows.selectExpr(
        *columns,
        f"named_struct('action', case when {valid} then _tried end, 'lost', {lost}, {values}, 'lot', _lot, "
        f"'degenerate', {degenerate_sql('_z.entry', '_z.sl')}) as _{kind}",
    )


def order_events(
    zones: DataFrame,
    symbol_info: DataFrame,
    balance: str,
    status: DataFrame | None = None,
    risk_percent: float = RISK_PERCENT,
    layout: Layout = Layout(),
) -> DataFrame:
    """Every attempt and reset: ``symbol, ts, type, side, action, bid, ask``, the zone, ``lot`` and ``degenerate``.

    ``zones`` is the result of ``detect_zones`` on bars with ``bid`` and ``ask`` at their first tick, ``balance`` the SQL of the
    balance at a bar, ``status`` the broker's answers (see ``mark_status``). ``action`` is ``PLACE``, ``REJECT``, ``SKIP``, or ``RESET``
    at the first bar after a check that found an order gone, with the zone that is no longer valid.
    """
    needed = ["symbol", "ts", "rn", "n", "bid", "ask", *[f"{k}_{c}" for k in KINDS for c in ZONE_COLUMNS]]
    marked = mark_status(zones, status, layout)
    info = symbol_info.select("symbol", *SYMBOL_INFO)
    rows = join_salted(marked, info, ["symbol"], "rn").selectExpr("*", f"{chunk_sql(layout)} as _chunk")
    others = [c for c in rows.columns if c not in needed and not any(c.startswith(f"{k}_") for k in KINDS)]
    marks = [f"{k}_{e}" for k in KINDS for e in ("rejected", "gone")]
    rows = stage(rows.select(*needed, *marks, *others), "order-bars")
    for kind in KINDS:
        rows = stage(_attempts(rows, kind, balance, risk_percent, layout), f"order-{kind}")

    def event(kind: str, action: str, when: str, zone: str, rest: str) -> str:
        fields = ", ".join(f"'{c}', {zone}.{c}" for c in ZONE_COLUMNS)
        head = f"'type', '{kind.upper()}', 'side', '{SIDES[kind]}', 'action', {action}"
        return f"case when {when} then named_struct({head}, {fields}, {rest}) end"

    no_lot = "'lot', cast(null as double), 'degenerate', cast(null as boolean)"
    events = [event(k, "'RESET'", f"_{k}.lost is not null", f"_{k}.lost", no_lot) for k in KINDS]
    events += [
        event(k, f"_{k}.action", f"_{k}.action is not null", f"_{k}", f"'lot', _{k}.lot, 'degenerate', _{k}.degenerate")
        for k in KINDS
    ]
    return rows.selectExpr("symbol", "ts", "bid", "ask", f"explode(array_compact(array({', '.join(events)}))) as _e").selectExpr(
        "symbol", "ts", "_e.type", "_e.side", "_e.action", "bid", "ask",
        *[f"_e.{c}" for c in (*ZONE_COLUMNS, "lot", "degenerate")],
    )
