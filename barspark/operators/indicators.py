"""Technical indicators: rolling means, exponential means and what is built from them.

Each function takes bars (``symbol, ts, open, high, low, close, volume``) and adds columns. ``rn`` and
``n`` (position and length of the series) are kept in the result, so that calls can be chained without
numbering again.

``smoothing`` picks the dialect of RSI, ATR, DI and ADX: ``"simple"`` (14-row means) or ``"wilder"``
(exponential mean with alpha 1/14).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions import candles
from ..functions.safe import rolling_mean_sql, rolling_std_sql
from ..plans import Layout, ewm, number_rows, numbered_once, settle, span_alpha, spread

MEAN_SPANS = (5, 10, 20, 50)
PERIOD = 14
SIMPLE, WILDER = "simple", "wilder"

Adder = Callable[[DataFrame], DataFrame]


def _rolling(bars: DataFrame, layout: Layout, back: int, add: Adder) -> DataFrame:
    """Run ``add`` over chunks that see ``back`` earlier rows; ``_chunk`` stays in the result."""
    return settle(add(spread(number_rows(bars, layout), layout, back=back)))


def check_smoothing(smoothing: str) -> None:
    if smoothing not in (SIMPLE, WILDER):
        raise ValueError(f"smoothing must be {SIMPLE!r} or {WILDER!r}, got {smoothing!r}")


def add(df: DataFrame, **columns: str) -> DataFrame:
    """Append SQL expressions as columns."""
    return df.selectExpr("*", *[f"{sql} as `{name}`" for name, sql in columns.items()])


# --- column builders: no exchange of their own, they share the caller's chunks -----------------


def add_return(df: DataFrame) -> DataFrame:
    return add(df, **{"return": candles.simple_return()})


def add_sma(df: DataFrame, spans=MEAN_SPANS, ratio: bool = True) -> DataFrame:
    df = add(df, **{f"sma_{k}": rolling_mean_sql("close", k) for k in spans})
    if ratio:
        df = add(df, **{f"sma_ratio_{k}": f"try_divide(close, sma_{k})" for k in spans})
    return df


def add_bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    df = add(df, bb_middle=rolling_mean_sql("close", n), bb_std=rolling_std_sql("close", n))
    df = add(
        df,
        bb_upper=f"bb_middle + {float(k)!r}D * bb_std",
        bb_lower=f"bb_middle - {float(k)!r}D * bb_std",
    )
    return add(df, bb_width="try_divide(bb_upper - bb_lower, bb_middle)")


def add_candle(df: DataFrame) -> DataFrame:
    return add(
        df,
        body_size=candles.BODY_SIZE,
        shadow_upper=candles.SHADOW_UPPER,
        shadow_lower=candles.SHADOW_LOWER,
        range=candles.RANGE,
    )


def add_gain_loss(df: DataFrame) -> DataFrame:
    return add(df, _gain=candles.gain(), _loss=candles.loss())


def add_true_range(df: DataFrame) -> DataFrame:
    return add(df, true_range=candles.true_range())


def add_moves(df: DataFrame) -> DataFrame:
    df = add(df, up_move=candles.change("high"), down_move=f"-{candles.change('low')}")
    return add(df, plus_dm=candles.PLUS_DM, minus_dm=candles.MINUS_DM)


def add_simple_rsi(df: DataFrame) -> DataFrame:
    """No loss in the frame gives 100, neither gain nor loss gives NULL."""
    df = add(
        add_gain_loss(df),
        _mean_gain=rolling_mean_sql("_gain", PERIOD),
        _mean_loss=rolling_mean_sql("_loss", PERIOD),
    )
    return add(
        df,
        rsi_14="case when _mean_loss = 0 and _mean_gain > 0 then 100D "
        "else 100 - 100 / (1 + try_divide(_mean_gain, _mean_loss)) end",
    ).drop("_gain", "_loss", "_mean_gain", "_mean_loss")


def add_wilder_rsi(df: DataFrame, gain: str, loss: str) -> DataFrame:
    """A ratio that cannot be formed (no loss yet) counts as 0, hence RSI 0."""
    return add(df, rsi_14=f"100 - 100 / (1 + coalesce(try_divide({gain}, {loss}), 0D))")


def add_di(df: DataFrame, plus: str, minus: str, atr: str) -> DataFrame:
    df = add(
        df,
        plus_di_14=f"100 * try_divide({plus}, {atr})",
        minus_di_14=f"100 * try_divide({minus}, {atr})",
    )
    return add(
        df, dx_14="100 * abs(try_divide(plus_di_14 - minus_di_14, plus_di_14 + minus_di_14))"
    )


def add_simple_di(df: DataFrame) -> DataFrame:
    df = add(
        add_moves(add_true_range(df)),
        atr_14=rolling_mean_sql("true_range", PERIOD),
        _plus=rolling_mean_sql("plus_dm", PERIOD),
        _minus=rolling_mean_sql("minus_dm", PERIOD),
    )
    return add_di(df, "_plus", "_minus", "atr_14").drop("_plus", "_minus")


def add_simple_adx(df: DataFrame) -> DataFrame:
    return add(add_simple_di(df), adx_14=rolling_mean_sql("dx_14", PERIOD))


# --- public operators -------------------------------------------------------------------------


def with_return(bars: DataFrame, layout: Layout = Layout()) -> DataFrame:
    return _rolling(bars, layout, 1, add_return).drop("_chunk")


def with_sma(
    bars: DataFrame, spans=MEAN_SPANS, ratio: bool = True, layout: Layout = Layout()
) -> DataFrame:
    """``sma_k`` and, with ``ratio``, ``sma_ratio_k`` = close / sma_k."""
    return _rolling(bars, layout, max(spans) - 1, lambda df: add_sma(df, spans, ratio)).drop("_chunk")


def with_ema(bars: DataFrame, spans=MEAN_SPANS, layout: Layout = Layout()) -> DataFrame:
    rows = settle(spread(numbered_once(bars, layout), layout))
    return ewm(rows, {f"ema_{k}": ("close", span_alpha(k)) for k in spans}, layout).drop("_chunk")


def with_macd(
    bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, layout: Layout = Layout()
) -> DataFrame:
    """``ema_<fast>, ema_<slow>, macd, macd_signal, macd_hist``."""
    rows = settle(spread(numbered_once(bars, layout), layout))
    rows = ewm(rows, {f"ema_{k}": ("close", span_alpha(k)) for k in (fast, slow)}, layout)
    rows = add(rows, macd=f"ema_{fast} - ema_{slow}")
    rows = ewm(rows, {"macd_signal": ("macd", span_alpha(signal))}, layout)
    return add(rows, macd_hist="macd - macd_signal").drop("_chunk")


def with_rsi(bars: DataFrame, smoothing: str = WILDER, layout: Layout = Layout()) -> DataFrame:
    check_smoothing(smoothing)
    if smoothing == SIMPLE:
        return _rolling(bars, layout, PERIOD, add_simple_rsi).drop("_chunk")
    rows = _rolling(numbered_once(bars, layout), layout, 1, add_gain_loss)
    rows = ewm(rows, {"_g": ("_gain", 1 / PERIOD), "_l": ("_loss", 1 / PERIOD)}, layout)
    return add_wilder_rsi(rows, "_g", "_l").drop("_gain", "_loss", "_g", "_l", "_chunk")


def with_bollinger(
    bars: DataFrame, n: int = 20, k: float = 2.0, layout: Layout = Layout()
) -> DataFrame:
    return _rolling(bars, layout, n - 1, lambda df: add_bollinger(df, n, k)).drop("_chunk")


def with_candle_shape(bars: DataFrame) -> DataFrame:
    """Row-wise, so neither numbered nor shuffled."""
    return add_candle(bars)


def with_true_range(bars: DataFrame, layout: Layout = Layout()) -> DataFrame:
    return _rolling(bars, layout, 1, add_true_range).drop("_chunk")


def with_atr(bars: DataFrame, smoothing: str = WILDER, layout: Layout = Layout()) -> DataFrame:
    check_smoothing(smoothing)
    if smoothing == SIMPLE:
        return _rolling(
            bars,
            layout,
            PERIOD,
            lambda df: add(add_true_range(df), atr_14=rolling_mean_sql("true_range", PERIOD)),
        ).drop("_chunk")
    rows = _rolling(numbered_once(bars, layout), layout, 1, add_true_range)
    return ewm(rows, {"atr_14": ("true_range", 1 / PERIOD)}, layout).drop("_chunk")


def with_directional_movement(bars: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """``up_move, down_move, plus_dm, minus_dm``; the first row has no move, its DM is 0."""
    return _rolling(bars, layout, 1, add_moves).drop("_chunk")


def with_di(bars: DataFrame, smoothing: str = WILDER, layout: Layout = Layout()) -> DataFrame:
    """``plus_di_14, minus_di_14, dx_14`` and the ``atr_14`` they divide by."""
    check_smoothing(smoothing)
    if smoothing == SIMPLE:
        return _rolling(bars, layout, PERIOD, add_simple_di).drop("_chunk")
    return _wilder_di(bars, layout).drop("_chunk")


def _wilder_di(bars: DataFrame, layout: Layout) -> DataFrame:
    rows = _rolling(numbered_once(bars, layout), layout, 1, lambda df: add_moves(add_true_range(df)))
    specs = {"atr_14": "true_range", "_plus": "plus_dm", "_minus": "minus_dm"}
    rows = ewm(rows, {out: (c, 1 / PERIOD) for out, c in specs.items()}, layout)
    return add_di(rows, "_plus", "_minus", "atr_14").drop("_plus", "_minus")


def with_adx(bars: DataFrame, smoothing: str = WILDER, layout: Layout = Layout()) -> DataFrame:
    check_smoothing(smoothing)
    if smoothing == SIMPLE:
        return _rolling(bars, layout, 2 * PERIOD, add_simple_adx).drop("_chunk")
    return ewm(_wilder_di(bars, layout), {"adx_14": ("dx_14", 1 / PERIOD)}, layout).drop("_chunk")
