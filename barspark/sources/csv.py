"""Bars from CSV files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.clean import OHLC, clean_bars, coerce_numeric, parse_time

# Column order of the headerless file, and words that mark a time column.
OHLCV_ORDER = ("time", "open", "high", "low", "close", "volume")
TIME_WORDS = ("date", "time", "timestamp")


def _named(symbol: str | None) -> Column:
    return F.col("symbol") if symbol is None else F.lit(symbol)


def read_ohlcv_raw(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Headerless ``time, open, high, low, close, volume`` as text; further columns are ignored.

    Without a ``symbol`` the path has a folder ``symbol=...`` for each. A file with fewer columns is an error, as is one
    where no row has all six.
    """
    found = [c for c in spark.read.option("header", False).csv(path).columns if symbol is not None or c != "symbol"]
    if len(found) < len(OHLCV_ORDER):
        raise ValueError(f"expected {len(OHLCV_ORDER)} columns {', '.join(OHLCV_ORDER)}, found {len(found)}")
    schema = ", ".join(f"{c} string" for c in (*OHLCV_ORDER, *(["symbol"] if symbol is None else [])))
    rows = spark.read.schema(schema).option("header", False).option("mode", "PERMISSIVE").csv(path)
    return rows.select(_named(symbol).alias("symbol"), F.col("time").alias("ts"), *OHLCV_ORDER[1:])


def read_ohlcv(spark: SparkSession, path: str, symbol: str | None = None, fmt: str | None = None) -> DataFrame:
    """Typed bars: rows with an unreadable time or a missing number are dropped."""
    return clean_bars(read_ohlcv_raw(spark, path, symbol), fmt)


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def repair_columns(df: DataFrame, required: Sequence[str] = OHLC) -> DataFrame:
    """Fill each missing column from the first one whose name contains it."""
    for name in required:
        if name in df.columns:
            continue
        similar = [c for c in df.columns if name in c.lower()]
        if not similar:
            raise ValueError(f"column {name} not found")
        df = df.withColumn(name, F.col(f"`{similar[0]}`"))
    return df


def find_time_column(columns: Sequence[str]) -> str | None:
    """The first column whose name contains date, time or timestamp."""
    return next((c for c in columns if any(word in c.lower() for word in TIME_WORDS)), None)


def read_ohlc(
    spark: SparkSession, path: str, symbol: str | None = None, fmt: str | None = None
) -> DataFrame:
    """Headered file with any-case names: ``symbol, ts, open, high, low, close`` and the other columns.

    Without a ``symbol`` the path has a folder ``symbol=...`` for each. Without a time column ``ts`` is NULL. Unlike the headerless reader nothing is dropped here.
    """
    reader = spark.read.option("header", True)
    if symbol is None:  # given as text, or folders like 007 would be numbers
        reader = reader.schema(", ".join(f"`{c}` string" for c in reader.csv(path).columns))
    df = repair_columns(lower_names(reader.csv(path)))
    time = find_time_column(df.columns)
    ts = parse_time(f"`{time}`", fmt) if time else F.lit(None).cast("timestamp")
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (time, *OHLC, "symbol", "ts")]
    typed = coerce_numeric(df.withColumn("_ts", ts), OHLC)
    return typed.select(_named(symbol).alias("symbol"), F.col("_ts").alias("ts"), *OHLC, *rest)
