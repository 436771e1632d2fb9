import numpy as np
import pandas as pd
import pytest
from conftest import ordered, random_bars, series

from barspark.operators import features as feat
from barspark.operators import indicators as ind
from barspark.plans import Layout

SMALL = Layout("H1", bucket_slots=40, chunk_rows=64, fanout=2)


def by_pandas(d: pd.DataFrame, smoothing: str) -> pd.DataFrame:
    d = d.copy()
    c = d.close

    def smooth(x):
        if smoothing == "simple":
            return x.rolling(14).mean()
        return x.ewm(alpha=1 / 14, adjust=False).mean()

    d["return"] = c.pct_change()
    for k in (5, 10, 20, 50):
        d[f"sma_{k}"] = c.rolling(k).mean()
        d[f"sma_ratio_{k}"] = c / d[f"sma_{k}"]
    for k in (5, 10, 12, 20, 26, 50):
        d[f"ema_{k}"] = c.ewm(span=k, adjust=False).mean()
    d["macd"] = d.ema_12 - d.ema_26
    d["macd_signal"] = d.macd.ewm(span=9, adjust=False).mean()
    d["macd_hist"] = d.macd - d.macd_signal
    move = c.diff()
    rs = smooth(move.clip(lower=0).fillna(0)) / smooth((-move).clip(lower=0).fillna(0))
    if smoothing == "wilder":
        rs = rs.replace([np.inf, -np.inf], np.nan).fillna(0)
    d["rsi_14"] = 100 - 100 / (1 + rs)
    d["bb_middle"], d["bb_std"] = c.rolling(20).mean(), c.rolling(20).std()
    d["bb_upper"], d["bb_lower"] = d.bb_middle + 2 * d.bb_std, d.bb_middle - 2 * d.bb_std
    d["bb_width"] = (d.bb_upper - d.bb_lower) / d.bb_middle
    d["body_size"] = (c - d.open).abs()
    d["shadow_upper"] = d.high - d[["open", "close"]].max(axis=1)
    d["shadow_lower"] = d[["open", "close"]].min(axis=1) - d.low
    d["range"] = d.high - d.low
    tr = pd.concat([d.high - d.low, (d.high - c.shift()).abs(), (d.low - c.shift()).abs()], axis=1).max(axis=1)
    d["atr_14"] = smooth(tr)
    d["up_move"], d["down_move"] = d.high.diff(), -d.low.diff()
    d["plus_dm"] = d.up_move.where((d.up_move > d.down_move) & (d.up_move > 0), 0.0)
    d["minus_dm"] = d.down_move.where((d.down_move > d.up_move) & (d.down_move > 0), 0.0)
    atr = d.atr_14.replace(0, np.nan)
    d["plus_di_14"], d["minus_di_14"] = 100 * smooth(d.plus_dm) / atr, 100 * smooth(d.minus_dm) / atr
    total = (d.plus_di_14 + d.minus_di_14).replace(0, np.nan)
    d["dx_14"] = 100 * (d.plus_di_14 - d.minus_di_14).abs() / total
    d["adx_14"] = smooth(d.dx_14)
    return d


@pytest.mark.parametrize("smoothing", ["simple", "wilder"])
@pytest.mark.parametrize("layout", [Layout("H1"), SMALL])
def test_feature_tables(spark, smoothing, layout):
    pdf = pd.concat([random_bars(200, "A", 5), random_bars(30, "B", 6)], ignore_index=True)
    got = ordered(feat.technical_features(spark.createDataFrame(pdf), smoothing, layout))
    want = pd.concat([by_pandas(g, smoothing) for _, g in pdf.groupby("symbol")], ignore_index=True)
    names = feat.WILDER_FEATURES if smoothing == "wilder" else feat.SIMPLE_FEATURES
    for name in names:
        have, need = got[name].astype(float), want[name].astype(float)
        assert (have.isna() == need.isna()).all(), name
        np.testing.assert_allclose(have, need, rtol=1e-8, atol=1e-8, err_msg=name)


def test_feature_order_and_model_columns(spark):
    df = feat.technical_features(spark.createDataFrame(random_bars(60)), "wilder", SMALL)
    assert df.columns[4:] == feat.WILDER_FEATURES and len(feat.WILDER_FEATURES) == 35
    assert len(feat.MODEL_FEATURES) == 26
    assert feat.model_features(df).columns == ["symbol", "ts", "rn", "n", *feat.MODEL_FEATURES]


def test_rsi_without_losses(spark):
    rising = spark.createDataFrame(series([(i, i + 1, i - 1, i + 0.5) for i in range(1, 61)]))
    simple = ordered(ind.with_rsi(rising, "simple", SMALL)).rsi_14
    assert simple[:13].isna().all() and (simple[13:] == 100).all()
    assert (ordered(ind.with_rsi(rising, "wilder", SMALL)).rsi_14 == 0).all()


def test_constant_series(spark):
    flat = spark.createDataFrame(series([(5, 5, 5, 5)] * 60))
    got = ordered(feat.technical_features(flat, "wilder", SMALL))
    assert (got.bb_std.dropna() == 0).all() and (got.atr_14 == 0).all()
    for name in ("plus_di_14", "minus_di_14", "adx_14"):
        assert got[name].isna().all()
    simple = ordered(ind.with_rsi(flat, "simple", SMALL)).rsi_14
    assert simple.isna().all()


def test_first_rows_with_a_value(spark):
    got = ordered(feat.technical_features(spark.createDataFrame(random_bars(60)), "simple", SMALL))
    first = {"return": 1, "sma_50": 49, "ema_50": 0, "rsi_14": 13, "bb_std": 19, "atr_14": 13, "plus_di_14": 13, "adx_14": 26}
    assert {c: int(got[c].notna().idxmax()) for c in first} == first


def test_zero_price_makes_no_infinity(spark):
    zero = spark.createDataFrame(series([(0, 0, 0, 0)] * 5 + [(1, 1, 1, 1)]))
    got = ordered(ind.with_sma(ind.with_return(zero, SMALL), (5,), layout=SMALL))
    assert np.isnan(got["return"][5]) and np.isnan(got.sma_ratio_5[4])


def test_unknown_smoothing_and_missing_columns(spark):
    with pytest.raises(ValueError):
        ind.with_rsi(spark.createDataFrame(random_bars(5)), "double")
    with pytest.raises(ValueError, match="volume"):
        feat.technical_features(spark.createDataFrame(random_bars(5).drop(columns="volume")))
