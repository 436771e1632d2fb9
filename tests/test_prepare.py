import math

import numpy as np
import pandas as pd
import pytest
from conftest import ordered, random_bars

from barspark.operators import clean, prepare as pr
from barspark.plans import Layout, number_rows

SMALL = Layout("H1", bucket_slots=40, chunk_rows=32, fanout=2)


def numbered(spark, pdf):
    return number_rows(spark.createDataFrame(pdf), SMALL)


@pytest.mark.parametrize("rows", [14, 15, 16, 100])
def test_windows_targets_and_splits(spark, rows):
    w, h = 10, 5
    pdf = random_bars(rows, seed=rows)
    got = pr.split_by_fraction(pr.sequences(numbered(spark, pdf), ["close", "volume"], w, h, layout=SMALL))
    got = got.orderBy("sample_id").toPandas()
    n = max(rows - w - h + 1, 0)
    assert got.sample_id.tolist() == list(range(n))
    x, y = pdf[["close", "volume"]].to_numpy(), pdf[["open", "high", "low", "close"]].to_numpy()
    for i, r in enumerate(got.itertuples()):
        np.testing.assert_array_equal(np.array([list(v) for v in r.x]), x[i : i + w])
        np.testing.assert_array_equal(r.y, y[i + w : i + w + h].ravel())
    t, v = int(n * 0.7), int(n * 0.15)
    assert got.split.tolist() == ["train"] * t + ["val"] * v + ["test"] * (n - t - v)
    if n:
        ceil = pr.split_by_ceil(spark.createDataFrame(got[["symbol", "sample_id", "samples"]]))
        rest = math.ceil(n * 0.3)
        last = math.ceil(rest * 0.5)
        labels = ceil.orderBy("sample_id").toPandas().split.tolist()
        assert labels == ["train"] * (n - rest) + ["val"] * (rest - last) + ["test"] * last


def test_training_ranges_end_one_row_late(spark):
    w, h, rows = 6, 3, 50
    pdf = random_bars(rows, seed=9)
    df = numbered(spark, pdf)
    t = int((rows - w - h + 1) * 0.7)
    x = pr.fit_minmax_train(df, ["close"], w, h).first()
    assert (x.close_min, x.close_max) == (pdf.close[: t + w].min(), pdf.close[: t + w].max())
    y = pr.fit_minmax_train(df, ["close"], w, h, of="targets").first()
    assert (y.close_min, y.close_max) == (pdf.close[w : t + w + h].min(), pdf.close[w : t + w + h].max())
    with pytest.raises(ValueError):
        pr.fit_minmax_train(df, ["close"], w, h, of="both")


def test_scaling_and_back(spark):
    pdf = pd.concat([random_bars(70, "A", 1), random_bars(40, "B", 2)], ignore_index=True)
    pdf["volume"] = 7.0
    df = numbered(spark, pdf)
    fitted = pr.fit_minmax(df, ["close", "volume"])
    scaled = pr.scale(df, fitted, ["close", "volume"], SMALL)
    got = ordered(scaled)
    want = pdf.groupby("symbol").close.transform(lambda c: (c - c.min()) / (c.max() - c.min()))
    np.testing.assert_allclose(got.close, want)
    assert (got.volume == 0).all()
    back = ordered(pr.inverse_scale(scaled, fitted, {"close": "close", "volume": "volume"}, SMALL))
    np.testing.assert_allclose(back.close, pdf.close)
    assert (back.volume == 7).all()


def test_split_report_names_empty_splits(spark):
    samples = spark.createDataFrame([("A", 0, 1)], "symbol string, sample_id long, samples long")
    got = {r.split: (r.rows, r.empty) for r in pr.split_report(pr.split_by_fraction(samples)).collect()}
    assert got == {"train": (0, True), "val": (0, True), "test": (1, False)}


def test_tail_window(spark):
    pdf = random_bars(30)
    assert ordered(pr.tail_window(numbered(spark, pdf), 4)).ts.tolist() == pdf.ts[-4:].tolist()


def test_cleaning_steps(spark):
    raw = spark.createDataFrame(
        [
            ("A", "2024-01-01 00:00:00", "1", "2", "1", "1", "5"),
            ("A", "not a time", "1", "2", "1", "1", "5"),
            ("A", "2024-01-02 00:00:00", "x", "2", "1", "1", "5"),
            ("A", "2024-01-03 00:00:00", "1", "NaN", "1", "1", "5"),
            ("A", "2024-01-04 00:00:00", "1", "Infinity", "1", "1", "5"),
        ],
        "symbol string, ts string, open string, high string, low string, close string, volume string",
    )
    report = clean.quality_report(raw).first()
    assert (report.rows, report.bad_time, report.null_values, report.infinite_values, report.kept) == (5, 1, 2, 1, 1)
    kept = clean.drop_inf(clean.clean_bars(raw), clean.OHLCV)
    assert kept.count() == 1 and dict(kept.dtypes)["open"] == "double"
    with pytest.raises(ValueError, match="bid"):
        clean.require_columns(kept, ["bid"])


def test_minimum_rows(spark):
    df = spark.createDataFrame(pd.concat([random_bars(15, "A"), random_bars(14, "B")]))
    got = {r.symbol: (r.samples, r.enough) for r in clean.require_rows(df, 10, 5).collect()}
    assert got == {"A": (1, True), "B": (0, False)}
    kept = clean.keep_long_series(number_rows(df, SMALL), 10, 5)
    assert [r.symbol for r in kept.select("symbol").distinct().collect()] == ["A"]


def test_duplicates_are_reported(spark):
    pdf = random_bars(5)
    twice = spark.createDataFrame(pd.concat([pdf, pdf[:1]]))
    assert [(r.ts, r.copies) for r in clean.duplicate_bars(twice).collect()] == [(pdf.ts[0], 2)]


def test_drops_are_counted_while_rows_pass(spark):
    good = ("2024-01-01 00:00:00", "1", "2", "0.5", "1", "3")
    rows = [("A", *good), ("A", "?", *good[1:]), ("B", *good[:3], None, *good[4:]), ("B", *good[:5], "Infinity"), ("B", *good)]
    raw = spark.createDataFrame(rows, "symbol string, ts string, open string, high string, low string, close string, volume string")
    cleaned, seen = clean.clean_counted(raw)
    kept = cleaned.collect()
    total = clean.quality_report(raw).groupBy().sum().first()
    assert seen.get == {c: total[f"sum({c})"] for c in ("rows", *clean.REASONS, "kept")}
    assert len(kept) == seen.get["kept"] == 2 and set(cleaned.columns) == set(raw.columns)
    nothing, seen = clean.clean_counted(raw.limit(0))
    assert nothing.count() == 0 and set(seen.get.values()) == {0}
