"""Sources, bars, look-ups and sinks."""

from __future__ import annotations

from ..operators.clean import sort_bars
from ..operators.indicators import add
from ..operators.trailing import own_positions
from ..plans import stage_path
from ..sources import bars as src
from ..sources.csv import read_ohlc, read_ohlcv
from ..sources.quotes import quotes_at
from ..sources.tables import risk_amount, with_symbol_info
from .base import HOURLY, TICKS_SQL, bars_sql, hourly, query, quotes, rounded, show, stamp, table, ticks

OHLCV = ["open", "high", "low", "close", "volume"]


def _bars_at(start: str) -> str:
    return f"""with {TICKS_SQL}
select symbol, {stamp()}, {rounded(*OHLCV)} from (
  select symbol, {start} as ts, first(price order by ts, tick_id) as open, max(price) as high,
    min(price) as low, last(price order by ts, tick_id) as close, count(*)::double as volume
  from ticks group by 1, 2)"""


_BAR_STARTS = {
    "m1": "date_trunc('minute', ts)",
    "m5": "time_bucket(interval 5 minutes, ts)",
    "m15": "time_bucket(interval 15 minutes, ts)",
    "m30": "time_bucket(interval 30 minutes, ts)",
    "h1": "date_trunc('hour', ts)",
    "h4": "time_bucket(interval 4 hours, ts)",
    "d1": "date_trunc('day', ts)",
    "w1": "date_trunc('day', ts) - to_days(dayofweek(ts)::int)",
    "mn1": "date_trunc('month', ts)",
}


def _register_bars(label: str, start: str) -> None:
    @query(f"bars_{label}", _bars_at(start))
    def bars(spark, sf):
        return show(src.to_bars(ticks(spark, sf), label.upper()), numbers=OHLCV)


for _label, _start in _BAR_STARTS.items():
    _register_bars(_label, _start)


@query(
    "bars_sorted",
    bars_sql(f"select symbol, {stamp()}, {rounded(*OHLCV)} from bars order by symbol, ts"),
)
def bars_sorted(spark, sf):
    return show(sort_bars(hourly(spark, sf)), numbers=OHLCV)


_CSV = bars_sql(f"select symbol, {stamp()}, {rounded(*OHLCV)} from bars")


def _as_text(spark, sf):
    """All series with times as text, as files would hold them."""
    return hourly(spark, sf).selectExpr("symbol", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') as time", *OHLCV)


@query("read_ohlcv", _CSV)
def headerless(spark, sf):
    path = stage_path(spark, "ohlcv-csv")
    _as_text(spark, sf).write.partitionBy("symbol").csv(path)
    return show(read_ohlcv(spark, path), numbers=OHLCV)


@query("read_ohlc", _CSV.replace(', round("volume", 6) + 0.0 as "volume"', ""))
def headered(spark, sf):
    path = stage_path(spark, "ohlc-csv")
    _as_text(spark, sf).selectExpr(
        "symbol", "time as `Bar_Time`", "open as `Open Price`", "high as HIGH", "low as `Low`", "close as `adj_Close`"
    ).write.partitionBy("symbol").option("header", True).csv(path)
    return show(read_ohlc(spark, path), numbers=OHLCV[:4])


@query(
    "bar_shift",
    bars_sql(
        f"""select symbol, {stamp()}, {rounded('open_1', 'close_1', 'open_2', 'close_2', 'high_100')} from (
  select symbol, ts, lag(open) over w as open_1, lag(close) over w as close_1, lag(open, 2) over w as open_2,
    lag(close, 2) over w as close_2, lag(high, 100) over w as high_100
  from bars window w as (partition by symbol order by ts))"""
    ),
)
def bar_shift(spark, sf):
    rows = src.bars_at_shift(hourly(spark, sf), 1, ("open", "close"), HOURLY)
    rows = src.bars_at_shift(rows, 2, ("open", "close"), HOURLY)
    rows = src.bars_at_shift(rows, 100, ("high",), HOURLY)
    return show(rows, numbers=["open_1", "close_1", "open_2", "close_2", "high_100"])


@query(
    "quotes_at",
    bars_sql(
        f"""select b.symbol, strftime(b.ts, '%Y-%m-%d %H:%M:%S') as ts, t.tick_id::double as quote_id,
  round(t.price, 6) + 0.0 as bid, round(t.price * 1.0002, 6) + 0.0 as ask
from bars b asof left join ticks t on b.symbol = t.symbol and b.ts >= t.ts"""
    ),
)
def quote_snapshot(spark, sf):
    given = quotes(spark, sf)
    at = quotes_at(hourly(spark, sf).select("symbol", "ts"), given)
    found = at.join(
        given.selectExpr("symbol", "ts as quote_ts", "cast(tick_id as double) as quote_id"), ["symbol", "quote_ts"], "left"
    )
    return show(found, ["symbol", "ts", "quote_id"], ["bid", "ask"])


@query(
    "new_bars",
    f"""with {TICKS_SQL}
select symbol, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as ts, min(ts)::varchar as first_ts,
  round(first(price order by ts, tick_id), 6) + 0.0 as price
from ticks group by symbol, date_trunc('hour', ticks.ts)""",
)
def first_ticks(spark, sf):
    rows = src.new_bars(ticks(spark, sf), "H1", ("price",))
    return rows.selectExpr(
        "symbol",
        "date_format(ts, 'yyyy-MM-dd HH:mm:ss') as ts",
        "cast(cast(first_ts as timestamp_ntz) as string) as first_ts",
        "round(price, 6) + 0D as price",
    )


@query(
    "timeframe_label",
    f"""with {TICKS_SQL}, gaps as (
  select symbol, case when l.s >= 1 then l.s end as seconds, count(*) as ticks from ticks,
    (values (60), (300), (900), (1800), (3600), (14400), (86400), (604800), (2419200), (77)) l(s)
  where ticks.tick_id % l.s = 0 group by 1, 2)
select symbol, seconds, ticks, case seconds when 60 then 'M1' when 300 then 'M5' when 900 then 'M15'
  when 1800 then 'M30' when 3600 then 'H1' when 14400 then 'H4' when 86400 then 'D1' when 604800 then 'W1'
  when 2419200 then 'MN1' else 'Unknown' end as label from gaps""",
)
def labels(spark, sf):
    lengths = "explode(array(60, 300, 900, 1800, 3600, 14400, 86400, 604800, 2419200, 77)) as seconds"
    rows = ticks(spark, sf).selectExpr("symbol", "tick_id", lengths).filter("tick_id % seconds = 0")
    from pyspark.sql import functions as F

    counted = rows.groupBy("symbol", "seconds").agg(F.count(F.lit(1)).alias("ticks"))
    return counted.withColumn("label", src.timeframe_of_seconds(F.col("seconds")))


def symbols(spark, sf):
    """Symbol constants worked out from the ticks: every symbol trades in hundredths."""
    from pyspark.sql import functions as F

    return ticks(spark, sf).groupBy("symbol").agg(
        F.lit(0.01).alias("point"),
        F.lit(1.0).alias("tick_value"),
        F.lit(0.01).alias("tick_size"),
        F.lit(0.01).alias("lot_min"),
        F.lit(50.0).alias("lot_max"),
        F.lit(0.01).alias("lot_step"),
        F.lit(5).alias("digits"),
    )


@query(
    "symbol_info",
    bars_sql(
        f"""select symbol, {stamp()}, round((high - low) / 0.01, 4) + 0.0 as points from bars"""
    ),
)
def info(spark, sf):
    rows = with_symbol_info(hourly(spark, sf), symbols(spark, sf))
    return show(add(rows, points="(high - low) / point"), numbers=["points"], digits=4)


@query(
    "account_risk",
    "select c_custkey as account_id, round(c_acctbal * (0.423::double / 100), 4) + 0.0 as risk_amount "
    "from customer",
)
def account_risk(spark, sf):
    accounts = table(spark, sf, "customer").selectExpr("c_custkey as account_id", "c_acctbal as balance")
    return show(risk_amount(accounts, 0.423), ["account_id"], ["risk_amount"], 4, ())


def positions(spark, sf):
    """Every seventh tick opens a position with a stop up to 49 away, one in three under another magic."""
    return ticks(spark, sf).filter("tick_id % 7 = 0").selectExpr(
        "tick_id as ticket",
        "case when tick_id % 3 = 0 then 999 else 123456 end as magic",
        "symbol",
        "case when tick_id % 2 = 0 then 'BUY' else 'SELL' end as type",
        "ts as open_ts",
        "price as price_open",
        "price + case when tick_id % 2 = 0 then -1 else 1 end * (tick_id % 50) as sl",
        "price as tp",
    )


POSITIONS_SQL = (
    TICKS_SQL
    + """, positions as (
  select tick_id as ticket, case when tick_id % 3 = 0 then 999 else 123456 end as magic, symbol,
    case when tick_id % 2 = 0 then 'BUY' else 'SELL' end as type, ts as open_ts, price as price_open,
    price + case when tick_id % 2 = 0 then -1 else 1 end * (tick_id % 50) as sl, price as tp
  from ticks where tick_id % 7 = 0)"""
)


@query(
    "own_positions",
    f"""with {POSITIONS_SQL}
select ticket, symbol, type, round(sl, 6) + 0.0 as sl from positions
where magic = 123456 and symbol = 'view'""",
)
def own(spark, sf):
    mine = own_positions(positions(spark, sf), 123456, "view")
    return show(mine, ["ticket", "symbol", "type"], ["sl"], 6, ())
