from datetime import datetime

import pandas as pd
import pytest
from conftest import ordered, random_bars
from pyspark.sql import functions as F

from barspark.operators import evaluate as ev
from barspark.sources import bars as src
from barspark.sources import sinks
from barspark.sources.csv import find_time_column, read_ohlc, read_ohlcv, repair_columns
from barspark.sources.tables import account_balance, symbol_info


def write(tmp_path, text):
    path = tmp_path / "bars.csv"
    path.write_text(text)
    return str(path)


def test_headerless_file(spark, tmp_path):
    path = write(
        tmp_path,
        "2024-01-02 00:00:00,1,2,0.5,1.5,10,extra\nbad,1,2,1,1,1,e\n2024-01-01 00:00:00,1,2,0.5,oops,10,e\n"
        "2024-01-03 00:00:00,3,4,2,3,7,e\n",
    )
    got = ordered(read_ohlcv(spark, path, "XAU"), "ts")
    assert got.columns.tolist() == ["symbol", "ts", "open", "high", "low", "close", "volume"]
    assert got.close.tolist() == [1.5, 3.0] and set(got.symbol) == {"XAU"}


def test_headerless_file_needs_six_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="found 5"):
        read_ohlcv(spark, write(tmp_path, "2024-01-02,1,2,3,4\n"), "XAU")


def test_a_folder_for_each_symbol(spark, tmp_path):
    for name, close in (("007", 1.5), ("12", 2.5)):
        for kind, head in (("plain", ""), ("headed", "Date,Open,High,Low,Close,Vol,Symbol_Old\n")):
            folder = tmp_path / kind / f"symbol={name}"
            folder.mkdir(parents=True)
            (folder / "bars.csv").write_text(f"{head}2024-01-02 00:00:00,1,2,0.5,{close},10,extra\n")
    for got in (read_ohlcv(spark, str(tmp_path / "plain")), read_ohlc(spark, str(tmp_path / "headed"))):
        assert sorted((r.symbol, r.close) for r in got.collect()) == [("007", 1.5), ("12", 2.5)]


def test_headered_file(spark, tmp_path):
    path = write(tmp_path, "Date,Open_Bid,HIGH,Low,Close,Other\n2024-01-02,1,2,0.5,1.5,q\n2024-01-03,,2,1,1,r\n")
    got = ordered(read_ohlc(spark, path, "XAU"), "ts")
    assert got.open[0] == 1 and pd.isna(got.open[1]) and got.other.tolist() == ["q", "r"]
    assert got.ts[0] == pd.Timestamp("2024-01-02")


def test_column_repair(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "first_open int, open_2 int, high int, low int, close int")
    assert repair_columns(df).first().open == 1
    with pytest.raises(ValueError, match="high"):
        repair_columns(df.drop("high"))
    assert find_time_column(["a", "Timestamp_x", "date"]) == "Timestamp_x"
    assert find_time_column(["a"]) is None


def test_weeks_start_on_sunday_and_months(spark):
    ts = ["2024-01-06 23:59:59", "2024-01-07 00:00:00", "2024-01-13 23:00:00", "2024-02-01 00:00:00"]
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.to_datetime(ts), "tick_id": range(4), "price": [1.0, 2, 3, 4]})
    ticks = spark.createDataFrame(pdf)
    weeks = ordered(src.to_bars(ticks, "W1"))
    assert weeks.ts.dt.day_name().unique().tolist() == ["Sunday"] and weeks.volume.tolist() == [1, 2, 1]
    months = ordered(src.to_bars(ticks, "MN1"))
    assert (months.open.tolist(), months.close.tolist()) == ([1, 4], [3, 4])
    monday = src.bar_time("W1", F.lit("2024-01-07 10:00:00").cast("timestamp"), week_start_days=4)
    assert spark.range(1).select(monday.alias("t")).first().t == datetime(2024, 1, 1)
    with pytest.raises(ValueError):
        src.to_bars(ticks, "H2")


def test_labels(spark):
    got = spark.range(1).select(
        src.timeframe_label("H4").alias("a"),
        src.timeframe_label("H3").alias("b"),
        src.timeframe_of_seconds(F.lit(604800)).alias("c"),
        src.timeframe_of_seconds(F.lit(5)).alias("d"),
    ).first()
    assert tuple(got) == ("H4", "Unknown", "W1", "Unknown")


def test_small_tables(spark):
    accounts = spark.createDataFrame([(1, 250.5)], "account_id int, balance double")
    assert account_balance(accounts, 1) == "250.5D"
    with pytest.raises(ValueError):
        account_balance(accounts, 2)
    with pytest.raises(ValueError, match="digits"):
        symbol_info(accounts.selectExpr("'A' as symbol", "1 as point", "1 as tick_value", "1 as tick_size", "1 as lot_min", "1 as lot_max", "1 as lot_step"))


def test_alert_text(spark):
    digits = spark.createDataFrame([("XAU", 2)], "symbol string, digits int")
    moves = spark.createDataFrame([("XAU", 7, datetime(2024, 1, 1), 1.236)], "symbol string, ticket long, moved_ts timestamp, new_sl double")
    assert sinks.stop_alerts(moves, digits, "M5").first().message == (
        "Trailing Stop diperbarui pada XAU, M5\nTicket: 7\nSL Baru: 1.24"
    )
    assert "telah dimulai pada XAU, Timeframe: H1" in sinks.run_alert(spark, "XAU", "H1").first().message


def test_reports(spark, tmp_path):
    rows = [("A", i, 1, "close", float(i), float(i) + 1, 0.5) for i in range(5)]
    df = spark.createDataFrame(rows, "symbol string, sample_id long, step int, component string, y_true double, y_pred double, close_now double")
    metrics = ev.metric_rows(ev.step_metrics(df), ev.precision_recall(ev.direction_now(df)))
    sinks.write_metrics(metrics, str(tmp_path / "m"))
    back = spark.read.option("header", True).csv(str(tmp_path / "m"))
    assert back.columns == ["symbol", "Timestep", "Komponen", "Metrik", "Nilai"] and back.count() == 7
    counts = spark.createDataFrame([("A", 5)], "symbol string, rows long")
    summary = sinks.summary_rows(metrics, counts, {"window": 3}, "bars.csv", datetime(2024, 5, 1))
    lines = [r.value for r in summary.orderBy("line_no").collect()]
    assert lines[0].startswith("===== RINGKASAN") and lines[-1].startswith("===== AKHIR")
    assert "Tanggal pelatihan: 2024-05-01 00:00:00" in lines and "Jumlah data setelah pembersihan: 5" in lines
    assert "Timestep 1 CLOSE: MSE=1.000000, R2=0.500000" in lines
    sinks.write_summary(summary, str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).count() == len(lines)


def test_forecast_file(spark, tmp_path):
    df = spark.createDataFrame(random_bars(3))
    sinks.write_forecast(df, str(tmp_path / "f"))
    assert spark.read.option("header", True).csv(str(tmp_path / "f")).columns == ["symbol", "date", "open", "high", "low", "close"]
    with pytest.raises(ValueError):
        sinks.write_forecast(df, str(tmp_path / "g"), "xml")
