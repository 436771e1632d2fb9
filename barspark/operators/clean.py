"""Cleaning, checks and row accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.safe import finite, to_number

OHLC = ("open", "high", "low", "close")
OHLCV = (*OHLC, "volume")


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def parse_time(column: str, fmt: str | None = None) -> Column:
    text = F.col(column).cast("string")
    return F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)


def coerce_time(df: DataFrame, column: str = "ts", fmt: str | None = None) -> DataFrame:
    """Parse the time and drop rows where it does not parse."""
    return df.withColumn(column, parse_time(column, fmt)).filter(F.col(column).isNotNull())


def coerce_numeric(df: DataFrame, columns: Sequence[str] = OHLCV) -> DataFrame:
    return df.withColumns({c: to_number(F.col(c)) for c in columns})


def drop_null(df: DataFrame, columns: Sequence[str] = OHLCV) -> DataFrame:
    return df.dropna(subset=list(columns))


def drop_warmup(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows in which any feature is still NULL."""
    return df.dropna(how="any", subset=list(columns) if columns else None)


def drop_inf(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinities and NaN count as missing; rows holding one are dropped."""
    usable = " and ".join(
        f"`{c}` is not null and not isnan(`{c}`) and abs(`{c}`) < double('infinity')" for c in columns
    )
    return df.filter(usable)


def clean_bars(raw: DataFrame, fmt: str | None = None) -> DataFrame:
    """Text columns ``ts, open..volume`` to typed bars without missing values."""
    return drop_null(coerce_numeric(coerce_time(raw, fmt=fmt)))


def sort_bars(df: DataFrame) -> DataFrame:
    """Physical order for a sink. Windows order by time themselves."""
    return df.orderBy("symbol", "ts")


def duplicate_bars(df: DataFrame) -> DataFrame:
    """``(symbol, ts)`` pairs that occur more than once; positions need them to be unique."""
    return (
        df.groupBy("symbol", "ts").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    )


def require_rows(df: DataFrame, window: int, horizon: int) -> DataFrame:
    """Per symbol: rows, usable samples ``n - window - horizon + 1`` and whether there is any."""
    samples = F.col("rows") - window - horizon + 1
    return (
        df.groupBy("symbol")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select("symbol", "rows", samples.alias("samples"), (samples > 0).alias("enough"))
    )


def keep_long_series(df: DataFrame, window: int, horizon: int) -> DataFrame:
    """Rows of the symbols that have at least one sample (``df`` carries ``n``)."""
    return require_columns(df, ["n"]).filter(F.col("n") - window - horizon + 1 > 0)


def quality_report(raw: DataFrame, columns: Sequence[str] = OHLCV, fmt: str | None = None) -> DataFrame:
    """Rows lost to each cleaning step, per symbol, in one aggregation over raw text columns."""
    time_ok = parse_time("ts", fmt).isNotNull()
    numbers = [to_number(F.col(c)) for c in columns]
    any_null = F.lit(False)
    any_inf = F.lit(False)
    for x in numbers:
        any_null = any_null | x.isNull()
        any_inf = any_inf | (F.abs(x) == F.lit(float("inf")))
    any_inf = F.coalesce(any_inf, F.lit(False))
    return raw.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~time_ok).alias("bad_time"),
        F.count_if(time_ok & any_null).alias("null_values"),
        F.count_if(time_ok & ~any_null & any_inf).alias("infinite_values"),
        F.count_if(time_ok & ~any_null & ~any_inf).alias("kept"),
    )


#: Why a row is dropped, in the order of the steps.
REASONS = ("bad_time", "null_values", "infinite_values")


def clean_counted(
    raw: DataFrame, columns: Sequence[str] = OHLCV, fmt: str | None = None
) -> tuple[DataFrame, Observation]:
    """``clean_bars`` without infinities, and what it drops, counted while the rows pass: no scan of its own.

    The observation has ``rows``, one count for each of ``REASONS`` and ``kept``, over all symbols, once an action on the
    cleaned rows has ended (``Observation.get``). It counts the first action only.
    """
    typed = coerce_numeric(raw, columns).withColumn("ts", parse_time("ts", fmt))
    null = " or ".join(f"`{c}` is null" for c in columns)
    infinite = " or ".join(f"abs(`{c}`) = double('infinity')" for c in columns)
    why = f"case when ts is null then 'bad_time' when {null} then 'null_values' when {infinite} then 'infinite_values' end"
    seen = Observation()
    counted = typed.withColumn("_why", F.expr(why)).observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col("_why") == reason).alias(reason) for reason in REASONS],
        F.count_if(F.col("_why").isNull()).alias("kept"),
    )
    return counted.filter("_why is null").drop("_why"), seen


def warmup_report(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows a symbol loses to ``drop_warmup``."""
    any_null = F.lit(False)
    for c in columns:
        any_null = any_null | F.col(c).isNull()
    return features.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(any_null).alias("warmup"),
        F.count_if(~any_null).alias("kept"),
    )


def valid_pairs(df: DataFrame, actual: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Keep rows where both values are finite."""
    return df.withColumns({c: finite(F.col(c)) for c in (actual, predicted)}).filter(
        F.col(actual).isNotNull() & F.col(predicted).isNotNull()
    )
