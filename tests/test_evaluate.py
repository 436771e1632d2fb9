import numpy as np
import pandas as pd
import pytest

from barspark.operators import evaluate as ev
from barspark.plans import Layout


def predictions(spark, actual, predicted, now=None, symbol="A"):
    pdf = pd.DataFrame({"y_true": actual, "y_pred": predicted}, dtype=float)
    pdf["close_now"] = 0.0 if now is None else now
    pdf["symbol"], pdf["sample_id"], pdf["step"], pdf["component"] = symbol, range(len(pdf)), 1, "close"
    return spark.createDataFrame(pdf)


def test_regression_metrics(spark):
    rng = np.random.default_rng(1)
    y, p = rng.normal(5, 2, 60), rng.normal(5, 2, 60)
    got = ev.step_metrics(predictions(spark, y, p)).first()
    assert got.mse == pytest.approx(np.mean((y - p) ** 2))
    assert got.mae == pytest.approx(np.mean(np.abs(y - p)))
    assert got.r2 == pytest.approx(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))


def test_r2_corner_cases(spark):
    assert ev.step_metrics(predictions(spark, [3, 3], [3, 3])).first().r2 == 1
    assert ev.step_metrics(predictions(spark, [3, 3], [3, 4])).first().r2 == 0
    assert ev.step_metrics(predictions(spark, [3], [3])).first().r2 is None


def test_unusable_pairs_and_empty_input(spark):
    df = predictions(spark, [1, np.nan, np.inf, 2], [1, 1, 1, np.nan])
    assert ev.step_metrics(df).first().rows == 1
    assert ev.step_metrics(df.limit(0)).count() == 0


def test_directions(spark):
    df = predictions(spark, [2, 1, 1, 3, 0], [2, 0, 1, 0, 0], now=1.0)
    now = ev.direction_now(df).orderBy("sample_id").toPandas()
    assert now.actual.tolist() == [1, 0, 0, 1, -1] and now.predicted.tolist() == [1, -1, 0, -1, -1]
    got = ev.precision_recall(ev.direction_now(df)).first()
    assert (got.accuracy, got.precision_up, got.recall_up) == (0.6, 1.0, 0.5)
    assert (got.precision_down, got.recall_down) == (pytest.approx(1 / 3), 1.0)
    diff = ev.direction_diff(df, Layout("H1", chunk_rows=2)).orderBy("sample_id").toPandas()
    assert diff.sample_id.tolist() == [1, 2, 3, 4]
    assert diff.actual.tolist() == [-1, 0, 1, -1] and diff.predicted.tolist() == [-1, 1, -1, 0]


def test_nothing_predicted_up_gives_zero(spark):
    got = ev.precision_recall(ev.direction_now(predictions(spark, [-1, -1], [-1, 0]))).first()
    assert (got.precision_up, got.recall_up, got.recall_down) == (0, 0, 0.5)


def test_three_class_confusion(spark):
    rows = [(-1, -1), (-1, 1), (0, 1), (1, 1), (1, -1), (1, 0), (1, 1)]
    df = spark.createDataFrame([("A", float(a), float(p)) for a, p in rows], "symbol string, actual double, predicted double")
    matrix = {r.actual: (r.down, r.flat, r.up) for r in ev.confusion_matrix(df).collect()}
    assert matrix == {-1: (1, 0, 1), 0: (0, 0, 1), 1: (1, 1, 2)}
    assert {(r.actual, r.predicted): r.rows for r in ev.confusion(df).collect()}[(1, 1)] == 2
    rates = ev.confusion_rates(df).first()
    assert rates.false_positive_rate == 0.5 and rates.false_negative_rate == pytest.approx(1 / 3)


def test_long_metrics_and_extract(spark):
    df = predictions(spark, range(130), range(130))
    rows = ev.metric_rows(ev.step_metrics(df), ev.precision_recall(ev.direction_now(df))).toPandas()
    assert rows.columns.tolist() == ["symbol", "Timestep", "Komponen", "Metrik", "Nilai"]
    assert set(rows.Metrik) == {"MSE", "R2", "accuracy", "precision_up", "recall_up", "precision_down", "recall_down"}
    assert set(rows[rows.Komponen == "Signal"].Timestep) == {"Timestep 1"}
    assert sorted(r.sample_id for r in ev.sample_extract(df, 100).collect()) == list(range(100))
