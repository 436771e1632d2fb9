"""Trailing stop: one move per position, at the first quote beyond one risk distance.

After the move the next trigger lies beyond the new stop's own distance and would set a stop behind the
present one, so a position moves at most once. What is left is a search: the first quote at or after the
opening whose bid (buy) is above, or whose ask (sell) is below, the trigger price.

The search walks a clock tree instead of pairing positions with quotes. A node covers a fixed span of
time and lists at most 1,000 children with their highest bid and lowest ask. A position climbs from its
opening microsecond until a later sibling crosses, then descends to the crossing microsecond. Each step is
one equi-join on ``(symbol, node)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans import join_salted, stage

# Fixed value: share of the risk distance that is locked in.
LOCKED = 0.764

# Microseconds covered by a node: 1 us, 1 ms, 1 s, 1,000 s, 1,000,000 s; above them one root per symbol,
# which has 3,156 children per century.
SPANS = (1, 10**3, 10**6, 10**9, 10**12)
ROOT = len(SPANS)


def own_positions(positions: DataFrame, magic: int, symbol: str | None = None) -> DataFrame:
    """Positions opened under one magic number, optionally of one symbol only."""
    mine = positions.filter(F.col("magic") == magic)
    return mine if symbol is None else mine.filter(F.col("symbol") == symbol)


def stop_candidates(positions: DataFrame) -> DataFrame:
    """Trigger and new stop of every position whose stop the move would improve."""
    distance = "abs(price_open - sl)"
    sign = "case when type = 'BUY' then 1 else -1 end"
    return (
        positions.filter("type in ('BUY', 'SELL')")
        .selectExpr(
            "*",
            f"price_open + {sign} * {distance} as trigger",
            f"price_open + {sign} * ({distance} * {LOCKED!r}D) as new_sl",
        )
        .filter("case when type = 'BUY' then new_sl > sl else new_sl < sl end")
    )


def _node(us: str, level: int) -> str:
    return "0L" if level == ROOT else _floor_div(us, SPANS[level])


def _floor_div(x: str, by: int) -> str:
    return f"(({x} - pmod({x}, {by}L)) div {by}L)"


def _extremes(quotes: DataFrame, level: int) -> DataFrame:
    """Highest bid and lowest ask of each node; combines on the map side."""
    return (
        quotes.selectExpr("symbol", "bid", "ask", f"{_node('unix_micros(ts)', level)} as _child")
        .groupBy("symbol", "_child")
        .agg(F.max("bid").alias("bid"), F.min("ask").alias("ask"))
    )


def _nodes(quotes: DataFrame, seconds: DataFrame, level: int) -> DataFrame:
    """Nodes of a level with their children in time order."""
    if level <= 2:
        children = _extremes(quotes, level - 1)
    else:
        span = SPANS[level - 1] // SPANS[2]
        children = (
            seconds.selectExpr("symbol", "bid", "ask", f"{_floor_div('_child', span)} as _child")
            .groupBy("symbol", "_child")
            .agg(F.max("bid").alias("bid"), F.min("ask").alias("ask"))
        )
    parent = "0L" if level == ROOT else _floor_div("_child", SPANS[level] // SPANS[level - 1])
    return (
        children.selectExpr("symbol", f"{parent} as _node", "struct(_child as id, bid, ask) as _c")
        .groupBy("symbol", "_node")
        .agg(F.sort_array(F.collect_list("_c")).alias("_children"))
    )


_CROSSED = "case when type = 'BUY' then c.bid > trigger else c.ask < trigger end"


def _first_child(condition: str) -> str:
    return f"try_element_at(filter(_children, c -> {condition}), 1).id"


def _visit(rows: DataFrame, nodes: DataFrame, level: int, found: str) -> DataFrame:
    """Join ``_node`` with its children and put the first fitting child into ``_next``.

    The nodes hold all quotes in arrays, which Spark takes for a small part of the size that they have; without the hint it
    would send them through the driver.
    """
    nodes = nodes.hint("merge")
    if level > 3:  # one node in 1,000,000 s: many positions share one
        joined = join_salted(rows, nodes, ["symbol", "_node"], "ticket")
    else:
        joined = rows.join(nodes, ["symbol", "_node"], "left")
    return joined.selectExpr(*[f"`{c}`" for c in rows.columns], f"{found} as _next")


def first_crossings(candidates: DataFrame, quotes: DataFrame) -> DataFrame:
    """``candidates`` (``ticket, symbol, type, open_ts, trigger``) that cross, with ``cross_ts``."""
    columns = candidates.columns
    seconds = stage(_extremes(quotes, 2), "seconds")
    levels = {k: _nodes(quotes, seconds, k) for k in range(1, ROOT + 1)}
    # a key that no node has, spread over tasks, for rows that are not at the level being joined
    absent = "-1L - pmod(xxhash64(ticket), 1000000000L)"
    rows = candidates.selectExpr(
        "*", "unix_micros(open_ts) as _us", "cast(null as int) as _level", "cast(null as bigint) as _at"
    )
    base = rows.columns

    def step(rows: DataFrame, level: int, here: str, node: str, condition: str) -> DataFrame:
        keyed = rows.selectExpr(*[f"`{c}`" for c in base], f"case when {here} then {node} else {absent} end as _node")
        visited = _visit(keyed, levels[level], level, _first_child(f"{condition} and {_CROSSED}"))
        return visited.selectExpr(
            *[f"`{c}`" for c in columns],
            "_us",
            f"case when _next is not null then {level - 1} else _level end as _level",
            "coalesce(_next, _at) as _at",
        )

    for level in range(1, ROOT + 1):
        later = ">=" if level == 1 else ">"
        own = _node("_us", level - 1)
        rows = step(rows, level, "_level is null", _node("_us", level), f"c.id {later} {own}")
    rows = rows.filter("_level is not null")
    for level in range(ROOT - 1, 0, -1):
        rows = step(rows, level, f"_level = {level}", "_at", "true")
    return rows.selectExpr(*[f"`{c}`" for c in columns], "timestamp_micros(_at) as cross_ts")


def trailing_stops(positions: DataFrame, quotes: DataFrame) -> DataFrame:
    """Stop moves: ``ticket, symbol, type, open_ts, price_open, sl, tp, new_sl, moved_ts``.

    ``quotes`` has ``symbol, ts, bid, ask``.
    """
    needed = ["ticket", "symbol", "type", "open_ts", "price_open", "sl", "tp", "trigger", "new_sl"]
    candidates = stop_candidates(positions).select(*needed)
    return first_crossings(candidates, quotes.select("symbol", "ts", "bid", "ask")).selectExpr(
        *[c for c in needed if c != "trigger"], "cross_ts as moved_ts"
    )
