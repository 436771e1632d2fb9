import numpy as np
import pandas as pd
import pytest
from conftest import ordered, random_bars

from barspark.operators import features as feat
from barspark.operators import forecast as fc
from barspark.operators import prepare as pr
from barspark.operators.clean import drop_warmup
from barspark.plans import Layout, number_rows, stage

LAYOUT = Layout("D1")
COLUMNS = ["open", "high", "low", "close", "ema_20", "macd_signal", "rsi_14", "adx_14"]
BARS = ["symbol", "ts", "open", "high", "low", "close", "volume"]


def prepared(spark, smoothing, w=5, h=2):
    pdf = pd.concat([random_bars(150, "A", 1, "1D"), random_bars(120, "B", 2, "1D")], ignore_index=True)
    bars = spark.createDataFrame(pdf)
    full = drop_warmup(feat.technical_features(bars, smoothing, LAYOUT).drop("rn", "n"))
    rows = stage(number_rows(full, LAYOUT), "rows")
    x, y = pr.fit_minmax_train(rows, COLUMNS, w, h), pr.fit_minmax_train(rows, list(pr.TARGETS), w, h, of="targets")
    named = y.selectExpr("symbol", "n", *[f"{c}_{m} as t_{c}_{m}" for c in pr.TARGETS for m in ("min", "max")])
    targets = [f"t_{c}" for c in pr.TARGETS]
    scaled = pr.scale(rows.selectExpr("*", *[f"{c} as t_{c}" for c in pr.TARGETS]), x, COLUMNS, LAYOUT)
    scaled = pr.scale(scaled, named, targets, LAYOUT)
    return pdf, bars, pr.sequences(scaled, COLUMNS, w, h, targets, LAYOUT), stage(x, "x"), stage(y, "y")


@pytest.mark.parametrize("smoothing", ["wilder", "simple"])
def test_appended_rows_continue_the_series(spark, smoothing):
    """Features of rows appended to a tail equal those of the whole series."""
    pdf = random_bars(140, seed=3, step="1D")
    whole = ordered(feat.scan_states(spark.createDataFrame(pdf), smoothing, LAYOUT))
    states = feat.scan_states(spark.createDataFrame(pdf[:135]), smoothing, LAYOUT)
    tail = states.filter("rn > n - 60").selectExpr("*", "false as _new").withColumn("_first", states.rn * 0)
    tail = stage(fc._rebase(tail.drop("_first")), "tail")
    more = spark.createDataFrame(pdf[135:]).selectExpr("*", "row_number() over (order by ts) + 60 as rn", "65L as n", "true as _new")
    grown = tail.unionByName(more, allowMissingColumns=True)
    got = ordered(fc._extend(grown, smoothing, LAYOUT))
    names = feat.WILDER_FEATURES if smoothing == "wilder" else feat.SIMPLE_FEATURES
    for name in names:
        np.testing.assert_allclose(got[name].astype(float), whole[name][135:].astype(float), rtol=1e-9, atol=1e-9, err_msg=name)


def test_fit_score_forecast_and_reload(spark, tmp_path):
    pdf, bars, samples, x, y = prepared(spark, "wilder")
    samples = stage(pr.split_by_fraction(samples), "samples")
    model = fc.fit_forecaster(samples.filter("split = 'train'"), COLUMNS, 5, 2, reg=0.001)
    scored = model.score(samples.filter("split = 'test'"))
    rows = fc.unscale_predictions(fc.prediction_rows(scored, 3), x, y, LAYOUT).toPandas()
    assert set(rows.step) == {1, 2} and set(rows.component) == set(pr.TARGETS)
    one = rows[(rows.symbol == "A") & (rows.sample_id == rows.sample_id.min()) & (rows.component == "close")]
    assert np.isfinite(rows.y_pred).all() and len(one) in (0, 2)
    closes = set(np.round(pdf.close, 6))
    assert set(np.round(rows.close_now, 6)) <= closes
    assert set(np.round(rows[rows.component == "close"].y_true, 6)) <= closes

    model.save(str(tmp_path / "model"))
    again = fc.Forecaster.load(str(tmp_path / "model"), COLUMNS, 5, 2)
    got = ordered(fc.forecast(bars, again, x, y, 5, "wilder", LAYOUT))
    assert got.groupby("symbol").day.apply(list).tolist() == [[1, 2, 3, 4, 5]] * 2
    last = pdf.groupby("symbol").ts.max()
    assert (got.ts - got.symbol.map(last) == pd.to_timedelta(got.day, "D")).all()
    assert np.isfinite(got[["open", "high", "low", "close"]].to_numpy()).all()


def test_lowest_validation_loss_wins(spark):
    df = spark.createDataFrame([(2, 0.5), (1, 0.5), (0, 0.7)], "model_id int, val_mse double")
    assert fc.best_model(df).first().model_id == 1


def test_unusable_windows_are_reported(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 2.0), ("B", 1.0), ("B", None), ("C", 1.0)], "symbol string, x double")
    got = {r.symbol: r.usable for r in fc.usable_inputs(df, ["x"], 2).collect()}
    assert got == {"A": True, "B": False, "C": False}


def test_future_dates(spark):
    got = fc.first_days(fc.future_dates(spark.createDataFrame(random_bars(3)), 9), 4).orderBy("day").toPandas()
    assert got.day.tolist() == [1, 2, 3, 4]
    assert (got.ts.diff().dropna() == pd.Timedelta(days=1)).all()
