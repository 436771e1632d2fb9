"""Report files and alert texts."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans import join_salted

REPORT_COLUMNS = ("Timestep", "Komponen", "Metrik", "Nilai")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metric rows as headered CSV files in one folder, written by as many tasks as there are partitions."""
    columns = [c for c in ("symbol", *REPORT_COLUMNS) if c in metrics.columns]
    metrics.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_forecast(forecast: DataFrame, path: str, fmt: str = "csv") -> None:
    """Forecast rows ``symbol, date, open, high, low, close``; ``fmt`` is csv or parquet."""
    rows = forecast.select("symbol", F.col("ts").alias("date"), "open", "high", "low", "close")
    writer = rows.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def summary_rows(
    metrics: DataFrame,
    row_counts: DataFrame,
    config: dict,
    dataset: str,
    trained_at: datetime | None = None,
) -> DataFrame:
    """The run summary as ordered text lines per symbol: ``symbol, line_no, value``.

    ``metrics`` comes from ``metric_rows``, ``row_counts`` has ``symbol, rows``.
    """
    when = (trained_at or datetime.now()).strftime("%Y-%m-%d %H:%M:%S")
    # Wording of the report.
    head = [
        "===== RINGKASAN MODEL =====",
        f"Tanggal pelatihan: {when}",
        f"Dataset: {dataset}",
    ]
    config_lines = ["Konfigurasi Pelatihan:", *json.dumps(config, indent=2).splitlines()]
    title = "Hasil Evaluasi:"
    foot = "===== AKHIR RINGKASAN ====="
    before = head + ["Jumlah data setelah pembersihan: %d"] + config_lines + [title]
    fixed = row_counts.select(
        "symbol",
        F.posexplode(
            F.array(
                *[
                    F.format_string(text, F.col("rows")) if "%d" in text else F.lit(text)
                    for text in before
                ]
            )
        ).alias("_k", "value"),
    ).select("symbol", F.struct(F.lit(0).alias("a"), F.col("_k").alias("b"), F.lit("").alias("c")).alias("_at"), "value")
    regression = metrics.filter("Komponen <> 'Signal'").groupBy("symbol", "Timestep", "Komponen").agg(
        F.expr("max(case when Metrik = 'MSE' then Nilai end)").alias("mse"),
        F.expr("max(case when Metrik = 'R2' then Nilai end)").alias("r2"),
    )
    steps = regression.select(
        "symbol",
        F.struct(F.lit(1).alias("a"), F.col("Timestep").cast("int").alias("b"), F.col("Komponen").alias("c")).alias("_at"),
        F.format_string("Timestep %s %s: MSE=%.6f, R2=%.6f", "Timestep", "Komponen", "mse", "r2").alias("value"),
    )
    signals = metrics.filter("Komponen = 'Signal'").select(
        "symbol",
        F.struct(F.lit(2).alias("a"), F.lit(0).alias("b"), F.col("Metrik").alias("c")).alias("_at"),
        F.format_string("%s: %.4f", "Metrik", "Nilai").alias("value"),
    )
    end = row_counts.select(
        "symbol",
        F.struct(F.lit(3).alias("a"), F.lit(0).alias("b"), F.lit("").alias("c")).alias("_at"),
        F.lit(foot).alias("value"),
    )
    lines = fixed.unionByName(steps).unionByName(signals).unionByName(end)
    # a report has a few hundred lines per symbol
    return lines.selectExpr(
        "symbol", "row_number() over (partition by symbol order by _at) as line_no", "value"
    )


def write_summary(summary: DataFrame, path: str) -> None:
    """One folder of text per symbol."""
    (
        summary.repartition("symbol")
        .sortWithinPartitions("symbol", "line_no")
        .select("symbol", "value")
        .write.mode("overwrite")
        .partitionBy("symbol")
        .text(path)
    )


# Wording of the notifications; prices are printed with the symbol's digits.
_ZONE_TITLES = {
    "SUPPLY": "Area Distribusi (Supply) terdeteksi pada ",
    "DEMAND": "Area Akumulasi (Demand) terdeteksi pada ",
}
_ORDER_TITLES = {
    "SELL_LIMIT": "Sell Limit berhasil dipasang pada ",
    "BUY_LIMIT": "Buy Limit berhasil dipasang pada ",
}
_STOP_TITLE = "Trailing Stop diperbarui pada "
_START_TITLE = "EA telah dimulai pada {}, Timeframe: {}"
_STOP_RUN_TITLE = "EA telah berhenti pada {}, Timeframe: {}"


def _price(column: str) -> str:
    return f"format_string(concat('%.', digits, 'f'), {column})"


def _text(title: str, timeframe: str, lines: dict[str, str]) -> str:
    body = ", ".join(f"concat('{label}: ', {sql})" for label, sql in lines.items())
    return f"concat_ws('\\n', concat({title}, symbol, ', {timeframe}'), {body})"


def _titles(column: str, titles: dict[str, str]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in titles.items()) + " end"


def zone_alerts(zones: DataFrame, digits: DataFrame, timeframe: str) -> DataFrame:
    """Text of every detected zone (``zone_rows``); ``digits`` has ``symbol, digits``."""
    lines = {
        "Upper": _price("upper"),
        "Lower": _price("lower"),
        "Entry": _price("entry"),
        "SL": _price("sl"),
        "TP": _price("tp"),
    }
    rows = join_salted(zones, digits.select("symbol", "digits"), ["symbol"], "ts")
    return rows.selectExpr(
        "symbol", "ts", "type", f"{_text(_titles('type', _ZONE_TITLES), timeframe, lines)} as message"
    )


def order_alerts(intents: DataFrame, digits: DataFrame, timeframe: str) -> DataFrame:
    """Text of every placed order; skipped ones send none."""
    lines = {
        "Entry": _price("entry"),
        "SL": _price("sl"),
        "TP": _price("tp"),
        "Lot Size": "format_string('%.2f', lot)",
    }
    placed = intents.filter("action = 'PLACE'")
    rows = join_salted(placed, digits.select("symbol", "digits"), ["symbol"], "ts")
    return rows.selectExpr(
        "symbol", "ts", "side", f"{_text(_titles('side', _ORDER_TITLES), timeframe, lines)} as message"
    )


def stop_alerts(moves: DataFrame, digits: DataFrame, timeframe: str) -> DataFrame:
    """Text of every moved stop."""
    lines = {"Ticket": "cast(ticket as string)", "SL Baru": _price("new_sl")}
    rows = join_salted(moves, digits.select("symbol", "digits"), ["symbol"], "ticket")
    title = f"'{_STOP_TITLE}'"
    return rows.selectExpr(
        "symbol", "moved_ts as ts", "ticket", f"{_text(title, timeframe, lines)} as message"
    )


def run_alert(spark: SparkSession, symbol: str, timeframe: str, started: bool = True) -> DataFrame:
    """The message sent when a run starts or ends."""
    text = (_START_TITLE if started else _STOP_RUN_TITLE).format(symbol, timeframe)
    return spark.range(1).select(F.lit(symbol).alias("symbol"), F.lit(text).alias("message"))
