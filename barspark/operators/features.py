"""The full feature tables and the model's column list."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans import Layout, ewm, numbered_once, settle, span_alpha, spread
from . import indicators as ind
from .clean import require_columns

# Feature order of the wilder table.
WILDER_FEATURES = [
    "open", "high", "low", "close", "volume", "return",
    "sma_5", "sma_ratio_5", "sma_10", "sma_ratio_10",
    "sma_20", "sma_ratio_20", "sma_50", "sma_ratio_50",
    "ema_5", "ema_10", "ema_20", "ema_50",
    "macd", "macd_signal", "macd_hist", "rsi_14",
    "bb_middle", "bb_std", "bb_upper", "bb_lower", "bb_width",
    "body_size", "shadow_upper", "shadow_lower", "range",
    "atr_14", "plus_di_14", "minus_di_14", "adx_14",
]

# Feature order of the simple table (nothing is dropped there).
SIMPLE_FEATURES = [
    "open", "high", "low", "close", "return",
    "sma_5", "sma_ratio_5", "sma_10", "sma_ratio_10",
    "sma_20", "sma_ratio_20", "sma_50", "sma_ratio_50",
    "ema_5", "ema_10", "ema_20", "ema_50", "ema_12", "ema_26",
    "macd", "macd_signal", "macd_hist", "rsi_14",
    "bb_middle", "bb_std", "bb_upper", "bb_lower", "bb_width",
    "body_size", "shadow_upper", "shadow_lower", "range",
    "atr_14", "up_move", "down_move", "plus_dm", "minus_dm",
    "plus_di_14", "minus_di_14", "dx_14", "adx_14",
]

# The 26 inputs of the dense model.
MODEL_FEATURES = [
    "open", "high", "low", "close", "return",
    "sma_5", "sma_10", "sma_20", "sma_ratio_5", "sma_ratio_10",
    "ema_5", "ema_10", "ema_20",
    "macd", "macd_signal", "macd_hist",
    "rsi_14", "bb_width", "body_size", "shadow_upper", "shadow_lower",
    "range", "atr_14", "adx_14", "plus_di_14", "minus_di_14",
]

TARGETS = ["open", "high", "low", "close"]
LOOKBACK = max(ind.MEAN_SPANS) - 1
EMA_SPANS = (*ind.MEAN_SPANS, 12, 26)


def first_scan(smoothing: str) -> dict[str, tuple[str, float]]:
    """Exponential means over the bars themselves: output, input column, alpha."""
    specs = {f"ema_{k}": ("close", span_alpha(k)) for k in EMA_SPANS}
    if smoothing == ind.WILDER:
        a = 1 / ind.PERIOD
        specs |= {
            "_g": ("_gain", a),
            "_l": ("_loss", a),
            "atr_14": ("true_range", a),
            "_plus": ("plus_dm", a),
            "_minus": ("minus_dm", a),
        }
    return specs


def rolling_part(df: DataFrame, smoothing: str) -> DataFrame:
    """Columns that look back a fixed number of rows inside the chunk."""
    df = ind.add_candle(ind.add_bollinger(ind.add_sma(ind.add_return(df))))
    if smoothing == ind.SIMPLE:
        return ind.add_simple_adx(ind.add_simple_rsi(df))
    return ind.add_moves(ind.add_true_range(ind.add_gain_loss(df)))


def between_scans(
    df: DataFrame, smoothing: str
) -> tuple[DataFrame, dict[str, tuple[str, float]]]:
    """Columns built from the first means, and the means over those columns."""
    df = ind.add(df, macd="ema_12 - ema_26")
    second = {"macd_signal": ("macd", span_alpha(9))}
    if smoothing == ind.WILDER:
        df = ind.add_di(ind.add_wilder_rsi(df, "_g", "_l"), "_plus", "_minus", "atr_14")
        second["adx_14"] = ("dx_14", 1 / ind.PERIOD)
    return df, second


def scan_states(
    bars: DataFrame, smoothing: str = ind.WILDER, layout: Layout = Layout()
) -> DataFrame:
    """All features together with the means and inputs they are made of."""
    ind.check_smoothing(smoothing)
    needed = ["open", "high", "low", "close"] + (["volume"] if smoothing == ind.WILDER else [])
    require_columns(bars, ["symbol", "ts", *needed])
    df = spread(numbered_once(bars, layout), layout, back=LOOKBACK)
    df = ewm(settle(rolling_part(df, smoothing)), first_scan(smoothing), layout)
    df, second = between_scans(df, smoothing)
    return ind.add(ewm(df, second, layout), macd_hist="macd - macd_signal").drop("_chunk")


def technical_features(
    bars: DataFrame, smoothing: str = ind.WILDER, layout: Layout = Layout()
) -> DataFrame:
    """All indicators: ``symbol, ts, rn, n`` and the feature columns of the dialect.

    Every rolling frame and both levels of exponential means run in one partitioning by
    ``(symbol, chunk)``. Stage tables hold the numbered bars and the per-chunk means between levels.
    """
    kept = WILDER_FEATURES if smoothing == ind.WILDER else SIMPLE_FEATURES
    extra = ["volume"] if smoothing == ind.SIMPLE and "volume" in bars.columns else []
    return scan_states(bars, smoothing, layout).select("symbol", "ts", "rn", "n", *kept, *extra)


def model_features(features: DataFrame) -> DataFrame:
    """The keys and the 26 model inputs."""
    keys = [c for c in ("symbol", "ts", "rn", "n") if c in features.columns]
    return features.select(*keys, *MODEL_FEATURES)
