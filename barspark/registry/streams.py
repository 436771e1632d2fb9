"""Streaming runs over the events, compared with the batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import stage, stage_path
from ..sources import alert_log, sinks
from ..streaming import bars as sb
from ..streaming import signals as ss
from ..streaming import state as st
from .base import HOURLY, TICKS_SQL, bars_sql, hourly, query, quotes, rounded, show, stamp, ticks
from .signals import APART, BALANCE, LOOKBACK, MOVES_SQL, SHOW_MOVES, STATE_WALK, ZONE, ZONE_ALERTS_SQL, broker_status, detected, open_orders, order_log_sql
from .signals import show_moves, show_order_log, tracked, zones_sql
from .sources import OHLCV, positions, symbols
from ..operators.trailing import own_positions

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def tick_stream(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = sb.stream_ticks(spark, sf, EVENTS, "events.parquet")
    return events.selectExpr(
        "event_type as symbol", "cast(ts as timestamp) as ts", "event_id as tick_id", "value as price"
    )


def _run(stream, sink, spark, label: str) -> None:
    ss.start(stream, sink, stage_path(spark, f"{label}-checkpoint")).awaitTermination()


@query(
    "stream_bars",
    bars_sql(
        f"""select symbol, {stamp()}, {rounded(*OHLCV)} from bars
where ts + interval 1 hour <= (select max(ts) from ticks)"""
    ),
)
def closed_bars(spark, sf):
    """Bars closed by the watermark; the last bar of the run is still open."""
    path = stage_path(spark, "bars")
    writer = (
        sb.stream_bars(tick_stream(spark, sf), "H1")
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", stage_path(spark, "bars-checkpoint"))
        .trigger(availableNow=True)
    )
    writer.start().awaitTermination()
    return show(spark.read.parquet(path), numbers=OHLCV)


LATE_CUT, LATE_DELAY = "2024-01-15", "10 days"


@query(
    "stream_bars_late",
    f"""with arrived as (
  select event_type as symbol, ts, event_id as tick_id, value as price from events
  where event_id % 50 <> 0 or ts >= timestamp '{LATE_CUT}' or ts > (select max(ts) from events
    where ts < timestamp '{LATE_CUT}' and event_id % 50 <> 0) - interval '{LATE_DELAY}')
select symbol, strftime(date_trunc('hour', a.ts), '%Y-%m-%d %H:%M:%S') as ts, round(first(price order by a.ts, tick_id), 6) + 0.0 as open,
  round(max(price), 6) + 0.0 as high, round(min(price), 6) + 0.0 as low, round(last(price order by a.ts, tick_id), 6) + 0.0 as close,
  count(*)::double as volume
from arrived a group by symbol, date_trunc('hour', a.ts)
having date_trunc('hour', a.ts) + interval 1 hour <= (select max(ts) from events) - interval '{LATE_DELAY}'""",
)
def late_bars(spark, sf):
    """Bars of ticks some of which come twice, and some of which come late: by less than the delay, or by more."""
    every = ticks(spark, sf)
    held = F.col("tick_id") % 50 == 0
    first = every.filter((F.col("ts") < LATE_CUT) & ~held)
    runs = [first.unionByName(first.filter("tick_id % 20 = 1")), every.filter((F.col("ts") >= LATE_CUT) | held)]
    source, out, checkpoint = (stage_path(spark, f"late-{x}") for x in ("ticks", "bars", "checkpoint"))
    for rows in runs:
        rows.write.mode("append").parquet(source)
        stream = spark.readStream.schema(every.schema).parquet(source)
        bars = sb.stream_bars(stream, "H1", delay=LATE_DELAY, distinct=True)
        writer = bars.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
    return show(spark.read.schema(bars.schema).parquet(out), numbers=OHLCV)


@query(
    "stream_ticks",
    f"""with {TICKS_SQL} select symbol, count(*) as ticks, round(sum(price), 4) + 0.0 as total
from ticks group by 1""",
)
def tick_totals(spark, sf):
    """Every tick arrives once."""
    path = stage_path(spark, "ticks")

    def sink(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    _run(tick_stream(spark, sf), sink, spark, "ticks")
    rows = spark.read.parquet(path).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("ticks"), F.sum("price").alias("total")
    )
    return show(rows, ["symbol", "ticks"], ["total"], 4)


def _run_by_period(spark, sources: dict, build, label: str, cuts: tuple[str, ...]):
    """Let the rows of several streams arrive period by period; each arrival is one run from the same checkpoint.

    ``sources`` has tables with a time column each, ``build`` makes the result from streams of them.
    """
    folders = {name: stage_path(spark, f"{label}-{name}") for name in sources}
    out, checkpoint = stage_path(spark, label), stage_path(spark, f"{label}-checkpoint")
    edges = [None, *cuts, None]
    for low, high in zip(edges, edges[1:]):
        streams = []
        for name, (df, at) in sources.items():
            part = df
            if low:
                part = part.filter(F.col(at) >= low)
            if high:
                part = part.filter(F.col(at) < high)
            part.write.mode("append").parquet(folders[name])
            streams.append(spark.readStream.schema(df.schema).parquet(folders[name]))
        result = build(*streams)
        st.start_rows(result, out, checkpoint).awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


@query(
    "stream_zones",
    bars_sql(
        f"""select b.symbol, strftime(b.ts, '%Y-%m-%d %H:%M:%S') as ts, type, {stamp('zone_ts')}, {rounded(*ZONE[1:])}
from (select *, 'SUPPLY' as type from supply union all by name select *, 'DEMAND' as type from demand) z
join bars b on b.symbol = z.symbol and b.rn = z.rn""",
        *zones_sql(),
    ),
)
def zone_stream(spark, sf):
    """Zones of closed bars that arrive in three periods, each run from the state of the one before."""
    bars = hourly(spark, sf).select("symbol", "ts", "open", "high", "low", "close")
    rows = _run_by_period(spark, {"bars": (bars, "ts")}, lambda b: st.zone_stream(b, LOOKBACK), "zone-stream", ("2024-01-10", "2024-01-20"))
    return show(rows, ["symbol", "ts", "type", "zone_ts"], ZONE[1:], times=("ts", "zone_ts"))


@query("stream_trailing", f"with {MOVES_SQL} {SHOW_MOVES}")
def trailing_stream(spark, sf):
    """Stop moves of positions that open as the quotes arrive."""
    sources = {"positions": (own_positions(positions(spark, sf), 123456), "open_ts"), "quotes": (quotes(spark, sf), "ts")}
    rows = _run_by_period(spark, sources, lambda p, q: st.move_stream(p, q, parts=2), "move-stream", ("2024-01-15",))
    return show_moves(rows)


@query("stream_alerts", ZONE_ALERTS_SQL)
def alert_stream(spark, sf):
    """The text of every zone of bars that arrive in two periods, from an alert log with a commit for each batch."""
    bars = stage(hourly(spark, sf).select("symbol", "ts", "open", "high", "low", "close"), "alert-bars")
    digits = stage(symbols(spark, sf).select("symbol", "digits"), "alert-digits")
    source, log, checkpoint = (stage_path(spark, f"alert-{x}") for x in ("source", "log", "checkpoint"))
    st.use_state_store(spark)
    for part in ("ts < '2024-01-15'", "ts >= '2024-01-15'"):
        bars.filter(part).write.mode("append").parquet(source)
        found = st.zone_stream(spark.readStream.schema(bars.schema).parquet(source), LOOKBACK, APART)
        alert_log.start_alerts(sinks.zone_alerts(found, digits, "H1"), log, checkpoint).awaitTermination()
    rows = alert_log.read_alerts(spark, log, "symbol string, ts timestamp, type string, message string")
    return show(rows, ["symbol", "ts", "type", "message"])


ORDER_CUTS = ("2024-01-10", "2024-01-20")
# step by step: bars (kind 2), orders that are gone (1) and the checks after each run but the first (0)
_FLOW = f"""steps as (
  select *, row_number() over (partition by symbol order by ts, kind, s_gone) as k from (
  select symbol, ts, 2 as kind, rn, false as s_gone, false as d_gone from bars
  union all select symbol, ts, 1, null, tick_id % 11 = 0, tick_id % 11 = 1 from ticks where tick_id % 11 in (0, 1)
  union all select symbol, c.due, 0, null, false, false from (select distinct symbol from bars),
    (values {", ".join(f"(timestamp '{c}')" for c in ORDER_CUTS[1:])}, (timestamp '9999-01-01')) c(due))),
flow as (
  select symbol, 0::bigint as k, null::timestamp as ts,
    null::double as s_e, null::double as s_l, null::double as s_p, null::double as d_e, null::double as d_l, null::double as d_p,
    false as s_open, false as s_ticket, false as s_flag, false as d_open, false as d_ticket, false as d_flag,
    false as s_reset, false as d_reset, null::varchar as s_action, null::varchar as d_action
  from (select distinct symbol from bars)
  union all
  select symbol, k, ts, s_e, s_l, s_p, d_e, d_l, d_p,
    s_open1 and not s_reset and coalesce(s_action, '') not in ('SKIP', 'PLACE'),
    (s_ticket and not s_reset) or coalesce(s_action = 'PLACE', false),
    (s_flag or (s_gone and s_ticket)) and not s_reset and coalesce(s_action, '') <> 'PLACE',
    d_open1 and not d_reset and coalesce(d_action, '') not in ('SKIP', 'PLACE'),
    (d_ticket and not d_reset) or coalesce(d_action = 'PLACE', false),
    (d_flag or (d_gone and d_ticket)) and not d_reset and coalesce(d_action, '') <> 'PLACE',
    s_reset, d_reset, s_action, d_action
  from (select *, case when kind < 2 or not d_open1 or coalesce(s_action = 'SKIP', false) then null when bid > d_e then 'SKIP'
      when d_rejected then 'REJECT' else 'PLACE' end as d_action
  from (select *, case when kind < 2 or not s_open1 then null when ask < s_e then 'SKIP' when s_rejected then 'REJECT' else 'PLACE' end as s_action
  from (select e.symbol, e.k, e.ts, e.kind, e.s_gone, e.d_gone, x.bid, x.ask, x.s_rejected, x.d_rejected,
      w.s_ticket, w.s_flag, w.d_ticket, w.d_flag,
      e.kind = 0 and w.s_ticket and w.s_flag as s_reset, e.kind = 0 and w.d_ticket and w.d_flag as d_reset,
      x.s_entry is not null or w.s_open as s_open1, x.d_entry is not null or w.d_open as d_open1,
      coalesce(x.s_entry, w.s_e) as s_e, case when x.s_entry is not null then x.s_sl else w.s_l end as s_l,
      case when x.s_entry is not null then x.s_tp else w.s_p end as s_p,
      coalesce(x.d_entry, w.d_e) as d_e, case when x.d_entry is not null then x.d_sl else w.d_l end as d_l,
      case when x.d_entry is not null then x.d_tp else w.d_p end as d_p
    from flow w join steps e on e.symbol = w.symbol and e.k = w.k + 1 left join seen x on x.symbol = e.symbol and x.rn = e.rn)))),
flow_log as (
  select symbol, ts, 'SUPPLY' as type, s_action as action, s_e as entry, s_l as sl, s_p as tp from flow where s_action is not null
  union all select symbol, ts, 'DEMAND', d_action, d_e, d_l, d_p from flow where d_action is not null
  union all select symbol, null, 'SUPPLY', 'RESET', s_e, null, null from flow where s_reset
  union all select symbol, null, 'DEMAND', 'RESET', d_e, null, null from flow where d_reset)"""


@query("stream_orders", bars_sql(order_log_sql("flow_log"), *zones_sql(0.9), STATE_WALK, _FLOW))
def stream_orders(spark, sf):
    """Orders of bars that arrive in three periods with the broker's answers; a timer checks the orders after the second
    and the third.
    """
    bars = stage(detected(spark, sf, APART).drop("rn", "n"), "order-stream-bars")
    status = broker_status(spark, sf)

    def build(b, s):
        return st.order_stream(b, stage(symbols(spark, sf), "symbols"), f"{BALANCE!r}D", s, every_seconds=0.001)

    return show_order_log(_run_by_period(spark, {"bars": (bars, "ts"), "status": (status, "ts")}, build, "order-stream", ORDER_CUTS))


@query(
    "stream_reconcile",
    "select o_orderkey as ticket from orders where o_orderkey > 0 and o_orderstatus <> 'O'",
)
def reconcile_stream(spark, sf):
    folder = stage_path(spark, "stale-stream")
    sink = ss.reconcile_sink(folder, tracked(spark, sf), lambda: open_orders(spark, sf))
    _run(tick_stream(spark, sf), sink, spark, "stale")
    return ss.read_output(spark, folder, "stale").select("ticket").distinct()
