"""Zones, order intents, lot sizes, reconciliation, trailing stops and alerts."""

from __future__ import annotations

from ..operators import order_state, orders, trailing, zones
from ..plans import numbered_once
from ..sources import sinks
from .base import HOURLY, bars_sql, hourly, query, quotes, rounded, show, stamp, table, ticks
from .sources import POSITIONS_SQL, positions, symbols

LOOKBACK = 100
ZONE = ("zone_ts", "upper", "lower", "entry", "sl", "tp")
BALANCE = 10000.0

# entry and stop coincide with the default fractions; this stop lies apart from the entry
APART = zones.ZoneLevels(sl=0.9)


def zones_sql(sl: float = 0.382) -> tuple[str, ...]:
    """The extreme closes looked up bar by bar, then the candle tests and levels."""
    return (
        f"""tops as (
  select b.symbol, b.rn, max(h.close) as close from bars b join bars h
    on h.symbol = b.symbol and h.rn between b.rn - {LOOKBACK} and b.rn - 1 and h.close > 0 group by 1, 2),
top_at as (
  select t.symbol, t.rn, t.close, max(h.rn) as at from tops t join bars h
    on h.symbol = t.symbol and h.rn between t.rn - {LOOKBACK} and t.rn - 1 and h.close = t.close
  group by 1, 2, 3),
lows as (
  select b.symbol, b.rn, min(h.close) as close from bars b join bars h
    on h.symbol = b.symbol and h.rn between b.rn - {LOOKBACK} and b.rn - 1
  where b.rn > {LOOKBACK} group by 1, 2),
low_at as (
  select t.symbol, t.rn, t.close, max(h.rn) as at from lows t join bars h
    on h.symbol = t.symbol and h.rn between t.rn - {LOOKBACK} and t.rn - 1 and h.close = t.close
  group by 1, 2, 3)""",
        f"""supply0 as (
  select t.symbol, t.rn, c.ts as zone_ts, c.high as upper, c.high - (c.high - p.low) * 0.618::double as entry,
    p.low + (c.high - p.low) * {sl}::double as sl
  from top_at t join bars c on c.symbol = t.symbol and c.rn = t.at
  join bars p on p.symbol = t.symbol and p.rn = t.at - 1
  where c.close > c.open and p.close > p.open),
supply as (select symbol, rn, zone_ts, upper, entry as lower, entry, sl,
  entry - abs(entry - sl) * 1.5 as tp from supply0),
demand0 as (
  select t.symbol, t.rn, c.ts as zone_ts, c.low as lower, c.low + (p.high - c.low) * 0.618::double as entry,
    p.high - (p.high - c.low) * {sl}::double as sl
  from low_at t join bars c on c.symbol = t.symbol and c.rn = t.at
  join bars p on p.symbol = t.symbol and p.rn = t.at - 1
  where c.close < c.open and p.close < p.open),
demand as (select symbol, rn, zone_ts, entry as upper, lower, entry, sl,
  entry + abs(entry - sl) * 1.5 as tp from demand0)""",
    )


def detected(spark, sf, levels=zones.ZoneLevels()):
    """Zones of the hourly bars; the quote at a bar's start is its first tick."""
    bars = hourly(spark, sf).selectExpr("*", "open as bid", "open * 1.0002D as ask")
    return zones.detect_zones(numbered_once(bars, HOURLY), LOOKBACK, levels, HOURLY)


@query(
    "highest_close",
    bars_sql(
        f"""select b.symbol, strftime(b.ts, '%Y-%m-%d %H:%M:%S') as ts, (b.rn - t.at)::double as highest_shift,
  round(t.close, 6) + 0.0 as highest_close from bars b left join top_at t on t.symbol = b.symbol and t.rn = b.rn""",
        *zones_sql()[:1],
    ),
)
def highest(spark, sf):
    rows = zones.extreme_closes(hourly(spark, sf), LOOKBACK, HOURLY)
    return show(rows, ["symbol", "ts"], ["highest_shift", "highest_close"])


@query(
    "lowest_close",
    bars_sql(
        f"""select b.symbol, strftime(b.ts, '%Y-%m-%d %H:%M:%S') as ts, (b.rn - t.at)::double as lowest_shift,
  round(t.close, 6) + 0.0 as lowest_close from bars b left join low_at t on t.symbol = b.symbol and t.rn = b.rn""",
        *zones_sql()[:1],
    ),
)
def lowest(spark, sf):
    rows = zones.extreme_closes(hourly(spark, sf), LOOKBACK, HOURLY)
    return show(rows, ["symbol", "ts"], ["lowest_shift", "lowest_close"])


@query(
    "candle_pairs",
    bars_sql(
        f"""select symbol, {stamp()},
  coalesce(close > open and lag(close) over w > lag(open) over w, false) as both_bullish,
  coalesce(close < open and lag(close) over w < lag(open) over w, false) as both_bearish
from bars window w as (partition by symbol order by ts)"""
    ),
)
def pairs(spark, sf):
    rows = zones.candle_pairs(hourly(spark, sf), HOURLY)
    return show(rows, ["symbol", "ts", "both_bullish", "both_bearish"])


def _zone_sql(kind: str) -> str:
    return bars_sql(
        f"""select b.symbol, strftime(b.ts, '%Y-%m-%d %H:%M:%S') as ts, {stamp('zone_ts')},
  {rounded(*ZONE[1:])} from {kind} z join bars b on b.symbol = z.symbol and b.rn = z.rn""",
        *zones_sql(),
    )


def _zones_of(spark, sf, kind: str):
    rows = zones.zone_rows(detected(spark, sf)).filter(f"type = '{kind}'")
    return show(rows, ["symbol", "ts", "zone_ts"], ZONE[1:], times=("ts", "zone_ts"))


@query("supply_zones", _zone_sql("supply"))
def supply_zones(spark, sf):
    return _zones_of(spark, sf, "SUPPLY")


@query("demand_zones", _zone_sql("demand"))
def demand_zones(spark, sf):
    return _zones_of(spark, sf, "DEMAND")


@query(
    "first_detections",
    bars_sql(
        f"""select symbol, type, count(*) as detections, count(distinct zone_ts) as zones,
  count(*) filter (new) as firsts from (
  select symbol, 'SUPPLY' as type, zone_ts, not coalesce(lag(zone_ts) over w = zone_ts and lag(rn) over w = rn - 1, false) as new
    from supply window w as (partition by symbol order by rn)
  union all
  select symbol, 'DEMAND', zone_ts, not coalesce(lag(zone_ts) over w = zone_ts and lag(rn) over w = rn - 1, false)
    from demand window w as (partition by symbol order by rn))
group by 1, 2""",
        *zones_sql(),
    ),
)
def firsts(spark, sf):
    from pyspark.sql import functions as F

    return zones.zone_rows(detected(spark, sf)).groupBy("symbol", "type").agg(
        F.count(F.lit(1)).alias("detections"),
        F.countDistinct("zone_ts").alias("zones"),
        F.count_if("first").alias("firsts"),
    )


@query(
    "last_zones",
    bars_sql(
        """select symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, round(last_value(s ignore nulls) over w, 6) + 0.0 as supply_entry,
  round(last_value(d ignore nulls) over w, 6) + 0.0 as demand_entry from (
  select b.symbol, b.ts, b.rn, s.entry as s, d.entry as d from bars b
  left join supply s on s.symbol = b.symbol and s.rn = b.rn
  left join demand d on d.symbol = b.symbol and d.rn = b.rn)
window w as (partition by symbol order by rn rows between unbounded preceding and current row)""",
        *zones_sql(),
    ),
)
def carried(spark, sf):
    rows = zones.last_zones(detected(spark, sf), HOURLY).selectExpr(
        "symbol", "ts", "last_supply.entry as supply_entry", "last_demand.entry as demand_entry"
    )
    return show(rows, numbers=["supply_entry", "demand_entry"])


def lot_sql(entry: str, sl: str) -> str:
    return f"""case when abs({entry} - {sl}) < 0.01::double / 2 then 50 else greatest(0.01, least(50,
    floor({BALANCE}::double * (0.423::double / 100) / ((abs({entry} - {sl}) / 0.01::double)
      * (1::double * 0.01::double / 0.01::double)) / 0.01::double) * 0.01::double)) end"""


@query(
    "lot_size",
    bars_sql(
        f"""select b.symbol, strftime(b.ts, '%Y-%m-%d %H:%M:%S') as ts, abs(entry - sl) < 0.01::double / 2 as degenerate,
  round({lot_sql('entry', 'sl')}, 4) + 0.0 as lot
from supply z join bars b on b.symbol = z.symbol and b.rn = z.rn""",
        *zones_sql(0.9),
    ),
)
def lot_size(spark, sf):
    found = zones.zone_rows(detected(spark, sf, APART)).filter("type = 'SUPPLY'")
    sized = orders.size_positions(found, symbols(spark, sf), f"{BALANCE!r}D")
    return show(sized, ["symbol", "ts", "degenerate"], ["lot"], 4)


# bar by bar, as the orders would be placed: waiting = the demand zone not attempted yet
_WALK = """events_at as (
  select b.symbol, b.rn, b.ts, b.open as bid, b.open * 1.0002::double as ask, s.entry as s_entry, s.sl as s_sl,
    s.tp as s_tp, d.entry as d_entry, d.sl as d_sl, d.tp as d_tp,
    coalesce(b.open * 1.0002::double < s.entry, false) as ended
  from bars b left join supply s on s.symbol = b.symbol and s.rn = b.rn
  left join demand d on d.symbol = b.symbol and d.rn = b.rn),
walk as (
  select symbol, rn, ts, bid, ask, s_entry, s_sl, s_tp, ended, d_entry as w_entry, d_sl as w_sl, d_tp as w_tp
  from events_at where rn = 1
  union all
  select e.symbol, e.rn, e.ts, e.bid, e.ask, e.s_entry, e.s_sl, e.s_tp, e.ended,
    case when e.d_entry is not null then e.d_entry when w.ended then w.w_entry end,
    case when e.d_entry is not null then e.d_sl when w.ended then w.w_sl end,
    case when e.d_entry is not null then e.d_tp when w.ended then w.w_tp end
  from walk w join events_at e on e.symbol = w.symbol and e.rn = w.rn + 1),
intents as (
  select symbol, ts, 'SELL_LIMIT' as side, case when ended then 'SKIP' else 'PLACE' end as action,
    s_entry as entry, s_sl as sl, s_tp as tp from walk where s_entry is not null
  union all
  select symbol, ts, 'BUY_LIMIT', case when bid > w_entry then 'SKIP' else 'PLACE' end, w_entry, w_sl, w_tp
  from walk where w_entry is not null and not ended)"""


def _intents_sql(where: str) -> str:
    return bars_sql(
        f"""select symbol, {stamp()}, side, action, {rounded('entry', 'sl', 'tp')},
  round({lot_sql('entry', 'sl')}, 4) + 0.0 as lot from intents where {where}""",
        *zones_sql(0.9),
        _WALK,
    )


def intents(spark, sf):
    found = detected(spark, sf, APART)
    return orders.order_intents(found, symbols(spark, sf), f"{BALANCE!r}D", layout=HOURLY)


def _show_intents(rows):
    numbers = [f"round({c}, 6) + 0D as {c}" for c in ("entry", "sl", "tp")]
    return rows.selectExpr(
        "symbol", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') as ts", "side", "action", *numbers, "round(lot, 4) + 0D as lot"
    )


@query("order_intents", _intents_sql("true"))
def all_intents(spark, sf):
    return _show_intents(intents(spark, sf))


@query("sell_intents", _intents_sql("side = 'SELL_LIMIT'"))
def sell_intents(spark, sf):
    return _show_intents(intents(spark, sf).filter("side = 'SELL_LIMIT'"))


@query("buy_intents", _intents_sql("side = 'BUY_LIMIT'"))
def buy_intents(spark, sf):
    return _show_intents(intents(spark, sf).filter("side = 'BUY_LIMIT'"))


def broker_status(spark, sf):
    """Answers worked out from the ticks: some orders of an hour are rejected, some checks find an order gone."""
    cases = "explode(array_compact(array({}))) as _e".format(
        ", ".join(
            f"case when tick_id % {by} = {at} then named_struct('type', '{kind}', 'event', '{event}') end"
            for by, at, kind, event in ((7, 0, "SUPPLY", "REJECTED"), (7, 1, "DEMAND", "REJECTED"), (11, 0, "SUPPLY", "GONE"), (11, 1, "DEMAND", "GONE"))
        )
    )
    rows = ticks(spark, sf).selectExpr("symbol", "ts", cases)
    return rows.selectExpr("symbol", "case when _e.event = 'REJECTED' then date_trunc('hour', ts) else ts end as ts", "_e.*")


# bar by bar with all state: the zones (s_, d_), what is valid and used, and the tickets
STATE_WALK = """marks as (
  select b.symbol, b.rn, coalesce(bool_or(t.tick_id % 7 = 0), false) as s_rejected, coalesce(bool_or(t.tick_id % 7 = 1), false) as d_rejected
  from bars b left join ticks t on t.symbol = b.symbol and date_trunc('hour', t.ts) = b.ts group by 1, 2),
checks as (
  select b.symbol, b.rn, coalesce(bool_or(t.tick_id % 11 = 0), false) as s_gone, coalesce(bool_or(t.tick_id % 11 = 1), false) as d_gone
  from bars b left join bars p on p.symbol = b.symbol and p.rn = b.rn - 1
  left join ticks t on t.symbol = b.symbol and t.ts <= b.ts and (p.ts is null or t.ts > p.ts) group by 1, 2),
seen as (
  select b.symbol, b.rn, b.ts, b.open as bid, b.open * 1.0002::double as ask, s_rejected, d_rejected, s_gone, d_gone,
    s.entry as s_entry, s.sl as s_sl, s.tp as s_tp, d.entry as d_entry, d.sl as d_sl, d.tp as d_tp
  from bars b join marks using (symbol, rn) join checks using (symbol, rn)
  left join supply s on s.symbol = b.symbol and s.rn = b.rn left join demand d on d.symbol = b.symbol and d.rn = b.rn),
book as (
  select symbol, 0::bigint as rn, null::timestamp as ts, null::double as bid, null::double as ask,
    null::double as s_e, null::double as s_l, null::double as s_p, null::double as d_e, null::double as d_l, null::double as d_p,
    false as s_open, false as s_ticket, false as d_open, false as d_ticket, false as s_reset, false as d_reset,
    null::double as s_lost, null::double as d_lost, null::varchar as s_action, null::varchar as d_action
  from (select distinct symbol from bars)
  union all
  select symbol, rn, ts, bid, ask, s_e, s_l, s_p, d_e, d_l, d_p,
    s_open1 and coalesce(s_action, '') not in ('SKIP', 'PLACE'), s_ticket1 or coalesce(s_action = 'PLACE', false),
    d_open1 and coalesce(d_action, '') not in ('SKIP', 'PLACE'), d_ticket1 or coalesce(d_action = 'PLACE', false),
    s_reset, d_reset, s_lost, d_lost, s_action, d_action
  from (select *, case when not d_open1 or coalesce(s_action = 'SKIP', false) then null when bid > d_e then 'SKIP'
      when d_rejected then 'REJECT' else 'PLACE' end as d_action
  from (select *, case when not s_open1 then null when ask < s_e then 'SKIP' when s_rejected then 'REJECT' else 'PLACE' end as s_action
  from (select e.*, w.s_ticket and e.s_gone as s_reset, w.d_ticket and e.d_gone as d_reset, w.s_e as s_lost, w.d_e as d_lost,
      w.s_ticket and not e.s_gone as s_ticket1, w.d_ticket and not e.d_gone as d_ticket1,
      e.s_entry is not null or (w.s_open and not (w.s_ticket and e.s_gone)) as s_open1,
      e.d_entry is not null or (w.d_open and not (w.d_ticket and e.d_gone)) as d_open1,
      coalesce(e.s_entry, w.s_e) as s_e, case when e.s_entry is not null then e.s_sl else w.s_l end as s_l,
      case when e.s_entry is not null then e.s_tp else w.s_p end as s_p,
      coalesce(e.d_entry, w.d_e) as d_e, case when e.d_entry is not null then e.d_sl else w.d_l end as d_l,
      case when e.d_entry is not null then e.d_tp else w.d_p end as d_p
    from book w join seen e on e.symbol = w.symbol and e.rn = w.rn + 1)))),
order_log as (
  select symbol, ts, 'SUPPLY' as type, s_action as action, s_e as entry, s_l as sl, s_p as tp from book where s_action is not null
  union all select symbol, ts, 'DEMAND', d_action, d_e, d_l, d_p from book where d_action is not null
  union all select symbol, ts, 'SUPPLY', 'RESET', s_lost, null, null from book where s_reset
  union all select symbol, ts, 'DEMAND', 'RESET', d_lost, null, null from book where d_reset)"""


def order_log_sql(log: str) -> str:
    return f"""select symbol, {stamp()}, type, action, {rounded('entry')},
  case when action <> 'RESET' then round(sl, 6) + 0.0 end as sl, case when action <> 'RESET' then round(tp, 6) + 0.0 end as tp,
  case when action <> 'RESET' then round({lot_sql('entry', 'sl')}, 4) + 0.0 end as lot from {log}"""


def show_order_log(rows):
    kept = [f"case when action <> 'RESET' then round({c}, 6) + 0D end as {c}" for c in ("sl", "tp")]
    return rows.selectExpr(
        "symbol", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') as ts", "type", "action", "round(entry, 6) + 0D as entry", *kept,
        "round(lot, 4) + 0D as lot",
    )


@query("order_events", bars_sql(order_log_sql("order_log"), *zones_sql(0.9), STATE_WALK))
def order_log(spark, sf):
    """Every attempt and reset, with rejected orders and orders that are gone."""
    found = detected(spark, sf, APART)
    rows = order_state.order_events(found, symbols(spark, sf), f"{BALANCE!r}D", broker_status(spark, sf), layout=HOURLY)
    return show_order_log(rows)


def tracked(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey as ticket",
        "o_orderpriority as symbol",
        "case when o_custkey % 2 = 0 then 'SUPPLY' else 'DEMAND' end as zone_type",
    )


def open_orders(spark, sf):
    return table(spark, sf, "orders").filter("o_orderstatus = 'O'").selectExpr("o_orderkey as ticket")


@query("stale_tickets", "select o_orderkey as ticket from orders where o_orderkey > 0 and o_orderstatus <> 'O'")
def stale(spark, sf):
    return orders.stale_tickets(tracked(spark, sf), open_orders(spark, sf)).select("ticket")


@query("live_tickets", "select o_orderkey as ticket from orders where o_orderkey > 0 and o_orderstatus = 'O'")
def live(spark, sf):
    return orders.live_tickets(tracked(spark, sf), open_orders(spark, sf)).select("ticket")


@query(
    "reset_zones",
    """select o_orderpriority as symbol, case when o_custkey % 2 = 0 then 'SUPPLY' else 'DEMAND' end as zone_type,
  count(*) filter (o_orderkey > 0 and o_orderstatus = 'O') as valid,
  count(*) filter (not (o_orderkey > 0 and o_orderstatus = 'O')) as reset from orders group by 1, 2""",
)
def reset(spark, sf):
    from pyspark.sql import functions as F

    rows = orders.reset_zones(tracked(spark, sf), open_orders(spark, sf))
    return rows.groupBy("symbol", "zone_type").agg(
        F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("reset")
    )


MOVES_SQL = (
    POSITIONS_SQL
    + """, stops as (
  select *, case when type = 'BUY' then price_open + abs(price_open - sl) else price_open - abs(price_open - sl) end as trigger,
    case when type = 'BUY' then price_open + abs(price_open - sl) * 0.764::double
      else price_open - abs(price_open - sl) * 0.764::double end as new_sl
  from positions where magic = 123456),
moves as (
  select s.ticket, s.symbol, any_value(s.type) as type, any_value(s.new_sl) as new_sl, min(t.ts) as moved_ts
  from stops s join ticks t on t.symbol = s.symbol and t.ts >= s.open_ts
    and case when s.type = 'BUY' then t.price > s.trigger else t.price * 1.0002::double < s.trigger end
  where case when s.type = 'BUY' then new_sl > sl else new_sl < sl end
  group by 1, 2)"""
)
SHOW_MOVES = (
    "select ticket, symbol, type, round(new_sl, 6) + 0.0 as new_sl, "
    "strftime(moved_ts, '%Y-%m-%d %H:%M:%S.%f') as moved_ts from moves"
)


def moves(spark, sf):
    return trailing.trailing_stops(
        trailing.own_positions(positions(spark, sf), 123456), quotes(spark, sf)
    )


def show_moves(rows):
    return rows.selectExpr(
        "ticket",
        "symbol",
        "type",
        "round(new_sl, 6) + 0D as new_sl",
        "date_format(moved_ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS') as moved_ts",
    )


@query("trailing_stops", f"with {MOVES_SQL} {SHOW_MOVES}")
def trailing_moves(spark, sf):
    return show_moves(moves(spark, sf))


def _message(title: str, lines: dict[str, str]) -> str:
    body = " || ".join(f"chr(10) || '{k}: ' || {v}" for k, v in lines.items())
    return f"{title} || symbol || ', H1' || {body} as message"


def _price(c: str) -> str:
    return f"printf('%.5f', {c})"


ZONE_ALERTS_SQL = bars_sql(
    f"select symbol, {stamp()}, type, "
    + _message(
        "case type when 'SUPPLY' then 'Area Distribusi (Supply) terdeteksi pada ' "
        "else 'Area Akumulasi (Demand) terdeteksi pada ' end",
        {"Upper": _price("upper"), "Lower": _price("lower"), "Entry": _price("entry"), "SL": _price("sl"), "TP": _price("tp")},
    )
    + """ from (select z.*, b.ts from (select *, 'SUPPLY' as type from supply union all by name
  select *, 'DEMAND' as type from demand) z join bars b on b.symbol = z.symbol and b.rn = z.rn)""",
    *zones_sql(0.9),
)


@query("zone_alerts", ZONE_ALERTS_SQL)
def zone_messages(spark, sf):
    found = zones.zone_rows(detected(spark, sf, APART))
    return show(sinks.zone_alerts(found, symbols(spark, sf), "H1"), ["symbol", "ts", "type", "message"])


@query(
    "order_alerts",
    bars_sql(
        f"select symbol, {stamp()}, side, "
        + _message(
            "case side when 'SELL_LIMIT' then 'Sell Limit berhasil dipasang pada ' "
            "else 'Buy Limit berhasil dipasang pada ' end",
            {"Entry": _price("entry"), "SL": _price("sl"), "TP": _price("tp"), "Lot Size": f"printf('%.2f', {lot_sql('entry', 'sl')})"},
        )
        + " from intents where action = 'PLACE'",
        *zones_sql(0.9),
        _WALK,
    ),
)
def order_messages(spark, sf):
    return show(
        sinks.order_alerts(intents(spark, sf), symbols(spark, sf), "H1"), ["symbol", "ts", "side", "message"]
    )


@query(
    "stop_alerts",
    f"with {MOVES_SQL} select ticket, "
    + _message("'Trailing Stop diperbarui pada '", {"Ticket": "ticket::varchar", "SL Baru": _price("new_sl")})
    + " from moves",
)
def stop_messages(spark, sf):
    return sinks.stop_alerts(moves(spark, sf), symbols(spark, sf), "H1").select("ticket", "message")
