"""Indicators and feature tables."""

from __future__ import annotations

from ..functions.safe import rolling_mean_sql
from ..operators import features as feat
from ..operators import indicators as ind
from ..operators.clean import drop_warmup, warmup_report
from ..plans import number_rows, settle, spread
from .base import DAILY, HOURLY, bars_sql, brand_days, hourly, query, rounded, show, stamp

W = "over (partition by symbol order by ts)"
SPANS = (5, 10, 20, 50)


def mean(x: str, n: int, agg: str = "avg") -> str:
    f = f"over (partition by symbol order by ts rows between {n - 1} preceding and current row)"
    return f"case when count({x}) {f} = {n} then {agg}({x}) {f} end"


# one bar's inputs of the exponential and rolling means
STEPS = f"""steps0 as (
  select *, lag(close) {W} as pc, high - lag(high) {W} as up_move, lag(low) {W} - low as down_move
  from bars),
steps as (
  select *, case when close - pc > 0 then close - pc else 0 end as gain,
    case when close - pc < 0 then pc - close else 0 end as loss,
    greatest(high - low, abs(high - pc), abs(low - pc)) as true_range,
    case when up_move > down_move and up_move > 0 then up_move else 0 end as plus_dm,
    case when down_move > up_move and down_move > 0 then down_move else 0 end as minus_dm
  from steps0)"""

EMAS = (*SPANS, 12, 26)


def _next(y: str, x: str, alpha: str) -> str:
    return f"(1 - {alpha}) * r.{y} + {alpha} * b.{x}"


A14 = "(1.0::double / 14)"
# all means bar by bar, exactly as the recurrences are written
MEANS = (
    """means as (
  select symbol, rn, """
    + ", ".join(f"close as ema_{k}" for k in EMAS)
    + """, gain as g, loss as l, true_range as atr_14, plus_dm as p, minus_dm as m,
    0::double as macd_signal, null::double as dx_14, null::double as adx_14, 1::double as wt
  from steps where rn = 1
  union all
  select symbol, rn, """
    + ", ".join(f"ema_{k}" for k in EMAS)
    + f""", g, l, atr_14, p, m, 0.8::double * sig + 0.2::double * (ema_12 - ema_26), dx,
    case when dx is null then adx when adx is null then dx
      else (wt * (1 - {A14}) * adx + {A14} * dx) / (wt * (1 - {A14}) + {A14}) end,
    case when dx is null then wt * (1 - {A14}) else 1 end
  from (
    select *, 100 * abs((100 * p / nullif(atr_14, 0) - 100 * m / nullif(atr_14, 0))
      / nullif(100 * p / nullif(atr_14, 0) + 100 * m / nullif(atr_14, 0), 0)) as dx
    from (
      select b.symbol, b.rn, """
    + ", ".join(f"{_next(f'ema_{k}', 'close', f'(2.0::double / {k + 1})')} as ema_{k}" for k in EMAS)
    + f""", {_next('g', 'gain', A14)} as g, {_next('l', 'loss', A14)} as l,
        {_next('atr_14', 'true_range', A14)} as atr_14, {_next('p', 'plus_dm', A14)} as p,
        {_next('m', 'minus_dm', A14)} as m, r.macd_signal as sig, r.adx_14 as adx, r.wt
      from means r join steps b on b.symbol = r.symbol and b.rn = r.rn + 1) x) y)"""
)

ROLLED = (
    "rolled as (select *, close / lag(close) "
    + W
    + ' - 1 as "return", '
    + ", ".join(f"{mean('close', k)} as sma_{k}" for k in SPANS)
    + f", {mean('close', 20)} as bb_middle, {mean('close', 20, 'stddev_samp')} as bb_std"
    + f", {mean('gain', 14)} as mean_gain, {mean('loss', 14)} as mean_loss"
    + f", {mean('true_range', 14)} as atr_simple, {mean('plus_dm', 14)} as mean_plus"
    + f", {mean('minus_dm', 14)} as mean_minus"
    + ' from steps), rolled2 as (select *, 100 * mean_plus / nullif(atr_simple, 0) as plus_simple'
    + ", 100 * mean_minus / nullif(atr_simple, 0) as minus_simple from rolled)"
    + ", rolled3 as (select *, 100 * abs((plus_simple - minus_simple) / nullif(plus_simple + minus_simple, 0))"
    + " as dx_simple from rolled2)"
    + f", rolled4 as (select *, {mean('dx_simple', 14)} as adx_simple from rolled3)"
)

COMMON = (
    '"return", '
    + ", ".join(f"sma_{k}, close / nullif(sma_{k}, 0) as sma_ratio_{k}" for k in SPANS)
    + """, bb_middle, bb_std, bb_middle + 2 * bb_std as bb_upper, bb_middle - 2 * bb_std as bb_lower,
    (bb_middle + 2 * bb_std - (bb_middle - 2 * bb_std)) / nullif(bb_middle, 0) as bb_width,
    abs(close - open) as body_size, high - greatest(open, close) as shadow_upper,
    least(open, close) - low as shadow_lower, high - low as "range", """
    + ", ".join(f"ema_{k}" for k in EMAS)
    + ", ema_12 - ema_26 as macd, macd_signal, ema_12 - ema_26 - macd_signal as macd_hist"
)

SIMPLE_SQL = f"""simple as (select x.symbol, ts, open, high, low, close, volume, {COMMON},
    case when mean_loss = 0 and mean_gain > 0 then 100
      else 100 - 100 / (1 + mean_gain / nullif(mean_loss, 0)) end as rsi_14,
    atr_simple as atr_14, up_move, down_move, plus_dm, minus_dm, plus_simple as plus_di_14,
    minus_simple as minus_di_14, dx_simple as dx_14, adx_simple as adx_14
  from rolled4 x join means m on m.symbol = x.symbol and m.rn = x.rn)"""

WILDER_SQL = f"""wilder as (select x.symbol, ts, open, high, low, close, volume, {COMMON},
    100 - 100 / (1 + coalesce(g / nullif(l, 0), 0)) as rsi_14, m.atr_14,
    100 * p / nullif(m.atr_14, 0) as plus_di_14, 100 * m.m / nullif(m.atr_14, 0) as minus_di_14,
    m.dx_14, m.adx_14
  from rolled4 x join means m on m.symbol = x.symbol and m.rn = x.rn)"""


def rolled_sql(*columns: str, digits: int = 6) -> str:
    return bars_sql(
        f"select symbol, {stamp()}, {rounded(*columns, digits=digits)} from simple",
        STEPS,
        MEANS,
        ROLLED,
        SIMPLE_SQL,
    )


def wilder_sql(*columns: str, digits: int = 4) -> str:
    return bars_sql(
        f"select symbol, {stamp()}, {rounded(*columns, digits=digits)} from wilder",
        STEPS,
        MEANS,
        ROLLED,
        WILDER_SQL,
    )


@query("bar_return", rolled_sql("return"))
def bar_return(spark, sf):
    return show(ind.with_return(hourly(spark, sf), HOURLY), numbers=["return"])


_SMA = [f"sma_{k}" for k in SPANS]


@query("sma", rolled_sql(*_SMA))
def sma(spark, sf):
    return show(ind.with_sma(hourly(spark, sf), ratio=False, layout=HOURLY), numbers=_SMA)


_RATIO = [f"sma_ratio_{k}" for k in SPANS]


@query("sma_ratio", rolled_sql(*_RATIO))
def sma_ratio(spark, sf):
    return show(ind.with_sma(hourly(spark, sf), layout=HOURLY), numbers=_RATIO)


_EMA = [f"ema_{k}" for k in EMAS]


@query("ema", wilder_sql(*_EMA))
def ema(spark, sf):
    return show(ind.with_ema(hourly(spark, sf), EMAS, HOURLY), numbers=_EMA, digits=4)


_MACD = ["macd", "macd_signal", "macd_hist"]


@query("macd", wilder_sql(*_MACD))
def macd(spark, sf):
    return show(ind.with_macd(hourly(spark, sf), layout=HOURLY), numbers=_MACD, digits=4)


@query("rsi_simple", rolled_sql("rsi_14"))
def rsi_simple(spark, sf):
    return show(ind.with_rsi(hourly(spark, sf), ind.SIMPLE, HOURLY), numbers=["rsi_14"])


@query("rsi_wilder", wilder_sql("rsi_14"))
def rsi_wilder(spark, sf):
    return show(ind.with_rsi(hourly(spark, sf), ind.WILDER, HOURLY), numbers=["rsi_14"], digits=4)


_BB = ["bb_middle", "bb_std", "bb_upper", "bb_lower", "bb_width"]


@query("bollinger", rolled_sql(*_BB))
def bollinger(spark, sf):
    return show(ind.with_bollinger(hourly(spark, sf), layout=HOURLY), numbers=_BB)


_CANDLE = ["body_size", "shadow_upper", "shadow_lower", "range"]


@query("candle_shape", rolled_sql(*_CANDLE))
def candle_shape(spark, sf):
    return show(ind.with_candle_shape(hourly(spark, sf)), numbers=_CANDLE)


@query(
    "true_range",
    bars_sql(f"select symbol, {stamp()}, {rounded('true_range')} from steps", STEPS),
)
def true_range(spark, sf):
    return show(ind.with_true_range(hourly(spark, sf), HOURLY), numbers=["true_range"])


@query("atr_simple", rolled_sql("atr_14"))
def atr_simple(spark, sf):
    return show(ind.with_atr(hourly(spark, sf), ind.SIMPLE, HOURLY), numbers=["atr_14"])


@query("atr_wilder", wilder_sql("atr_14"))
def atr_wilder(spark, sf):
    return show(ind.with_atr(hourly(spark, sf), ind.WILDER, HOURLY), numbers=["atr_14"], digits=4)


_DM = ["up_move", "down_move", "plus_dm", "minus_dm"]


@query("directional_movement", rolled_sql(*_DM))
def directional_movement(spark, sf):
    return show(ind.with_directional_movement(hourly(spark, sf), HOURLY), numbers=_DM)


_DI = ["plus_di_14", "minus_di_14"]


@query("di_simple", rolled_sql(*_DI))
def di_simple(spark, sf):
    return show(ind.with_di(hourly(spark, sf), ind.SIMPLE, HOURLY), numbers=_DI)


@query("di_wilder", wilder_sql(*_DI))
def di_wilder(spark, sf):
    return show(ind.with_di(hourly(spark, sf), ind.WILDER, HOURLY), numbers=_DI, digits=4)


@query("dx_simple", rolled_sql("dx_14"))
def dx_simple(spark, sf):
    return show(ind.with_di(hourly(spark, sf), ind.SIMPLE, HOURLY), numbers=["dx_14"])


@query("dx_wilder", wilder_sql("dx_14"))
def dx_wilder(spark, sf):
    return show(ind.with_di(hourly(spark, sf), ind.WILDER, HOURLY), numbers=["dx_14"], digits=4)


@query("adx_simple", rolled_sql("adx_14"))
def adx_simple(spark, sf):
    return show(ind.with_adx(hourly(spark, sf), ind.SIMPLE, HOURLY), numbers=["adx_14"])


@query("adx_wilder", wilder_sql("adx_14"))
def adx_wilder(spark, sf):
    return show(ind.with_adx(hourly(spark, sf), ind.WILDER, HOURLY), numbers=["adx_14"], digits=4)


@query("features_wilder", wilder_sql(*feat.WILDER_FEATURES))
def features_wilder(spark, sf):
    features = feat.technical_features(hourly(spark, sf), ind.WILDER, HOURLY)
    return show(features, numbers=feat.WILDER_FEATURES, digits=4)


@query("features_simple", rolled_sql(*feat.SIMPLE_FEATURES, digits=4))
def features_simple(spark, sf):
    features = feat.technical_features(hourly(spark, sf), ind.SIMPLE, HOURLY)
    return show(features, numbers=feat.SIMPLE_FEATURES, digits=4)


@query("model_features", rolled_sql(*feat.MODEL_FEATURES, digits=4))
def model_features(spark, sf):
    features = feat.technical_features(hourly(spark, sf), ind.SIMPLE, HOURLY)
    return show(feat.model_features(features), numbers=feat.MODEL_FEATURES, digits=4)


_ROLLING = ["sma_50", "bb_std", "rsi_14"]
_ANY_NULL = " or ".join(f"{c} is null" for c in _ROLLING)


def _some_features(spark, sf):
    bars = spread(number_rows(hourly(spark, sf), HOURLY), HOURLY, back=feat.LOOKBACK)
    rows = ind.add_simple_rsi(ind.add_bollinger(ind.add(bars, sma_50=rolling_mean_sql("close", 50))))
    return settle(rows)


@query(
    "warmup_dropped",
    bars_sql(
        f"select symbol, {stamp()}, {rounded(*_ROLLING)} from simple where not ({_ANY_NULL})",
        STEPS,
        MEANS,
        ROLLED,
        SIMPLE_SQL,
    ),
)
def warmup_dropped(spark, sf):
    return show(drop_warmup(_some_features(spark, sf), _ROLLING), numbers=_ROLLING)


@query(
    "warmup_report",
    bars_sql(
        f"""select symbol, count(*) as rows, count(*) filter ({_ANY_NULL}) as warmup,
  count(*) filter (not ({_ANY_NULL})) as kept from simple group by symbol""",
        STEPS,
        MEANS,
        ROLLED,
        SIMPLE_SQL,
    ),
)
def warmup_rows(spark, sf):
    return warmup_report(_some_features(spark, sf), _ROLLING)


@query(
    "brand_day_bollinger",
    f"""with bars as (
  select p_brand as symbol, date_trunc('day', l_shipdate) as ts,
    last(l_extendedprice / l_quantity order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey,
      l_extendedprice) as close
  from lineitem join part on l_partkey = p_partkey group by 1, 2),
bands as (select *, {mean('close', 20)} as bb_middle, {mean('close', 20, 'stddev_samp')} as bb_std from bars)
select symbol, {stamp()}, {rounded('bb_middle', 'bb_std')} from bands""",
)
def brand_day_bollinger(spark, sf):
    bars = ind.with_bollinger(brand_days(spark, sf), layout=DAILY)
    return show(bars, numbers=["bb_middle", "bb_std"])
