"""Bars from ticks, timeframes and look-ups by shift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans import SLOT_SECONDS, Layout, number_rows, over, settle, spread

# Spark interval of each timeframe that has a constant length.
_INTERVALS = {
    "M1": "1 minute",
    "M5": "5 minutes",
    "M15": "15 minutes",
    "M30": "30 minutes",
    "H1": "1 hour",
    "H4": "4 hours",
    "D1": "1 day",
    "W1": "7 days",
}


def bar_time(timeframe: str, ts: Column | None = None, week_start_days: int = 3) -> Column:
    """Start of the bar a time falls in.

    Weeks start on Sunday: day 0 of the epoch is a Thursday, so the offset is three days
    (four for Monday).
    """
    ts = F.col("ts") if ts is None else ts
    if timeframe == "MN1":
        return F.date_trunc("month", ts)
    if timeframe not in _INTERVALS:
        raise ValueError(f"unknown timeframe {timeframe!r}")
    length = SLOT_SECONDS[timeframe]
    offset = week_start_days * 86400 if timeframe == "W1" else 0
    slots = F.floor((F.unix_timestamp(ts) - offset) / length)
    return F.timestamp_seconds(slots * length + offset)


def timeframe_label(timeframe: Column | str) -> Column:
    """The timeframe's own label, ``Unknown`` for anything else."""
    code = F.lit(timeframe) if isinstance(timeframe, str) else timeframe
    return F.when(code.isin(*SLOT_SECONDS), code).otherwise(F.lit("Unknown"))


def timeframe_of_seconds(seconds: Column) -> Column:
    """Label of a bar length in seconds; a month is given by its shortest length."""
    label = F.lit("Unknown")
    for name, length in SLOT_SECONDS.items():
        label = F.when(seconds == length, name).otherwise(label)
    return label


def to_bars(
    ticks: DataFrame, timeframe: str, price: str = "price", tie: tuple[str, ...] = ("tick_id",)
) -> DataFrame:
    """``symbol, ts, <price>`` ticks to bars; volume is the number of ticks.

    ``(ts, *tie)`` must order the ticks of a symbol. The aggregates combine on the map side, so a busy
    symbol or hour sends one row per map task, not its ticks.
    """
    order = tick_order(ticks, tie)
    return (
        ticks.withColumn("_bar", bar_time(timeframe))
        .withColumn("_order", order)
        .groupBy("symbol", "_bar")
        .agg(
            F.min_by(price, "_order").alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, "_order").alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .withColumnRenamed("_bar", "ts")
    )


def tick_order(ticks: DataFrame, tie: tuple[str, ...]) -> Column:
    """A sort key for ``(ts, *tie)``.

    With no tie, or one integer, it is a plain number: then the aggregation hashes. A struct key would
    make Spark sort all ticks first.
    """
    if not tie:
        return F.expr("unix_micros(ts)")
    if len(tie) == 1 and dict(ticks.dtypes)[tie[0]] in ("tinyint", "smallint", "int", "bigint"):
        return F.expr(
            f"cast(unix_micros(ts) as decimal(38, 0)) * 10000000000000000000BD + `{tie[0]}`"
        )
    return F.struct("ts", *tie)


def new_bars(
    ticks: DataFrame, timeframe: str, columns: tuple[str, ...], tie: tuple[str, ...] = ("tick_id",)
) -> DataFrame:
    """The first tick of each bar: the one moment per bar at which signals are worked out.

    ``ts`` is the bar, ``first_ts`` the tick; ``columns`` are taken from that tick.
    """
    order = F.struct("ts", *tie)
    first = F.min_by(F.struct("ts", *columns), order).alias("_first")
    return (
        ticks.withColumn("_bar", bar_time(timeframe))
        .groupBy("symbol", "_bar")
        .agg(first)
        .select(
            "symbol",
            F.col("_bar").alias("ts"),
            F.col("_first.ts").alias("first_ts"),
            *[F.col(f"_first.{c}").alias(c) for c in columns],
        )
    )


def bars_at_shift(
    bars: DataFrame, shift: int, columns: tuple[str, ...] = ("open", "high", "low", "close", "ts"),
    layout: Layout = Layout(),
) -> DataFrame:
    """Add ``<column>_<shift>``: the value ``shift`` bars earlier (0 = the bar itself)."""
    rows = spread(number_rows(bars, layout), layout, back=shift)
    shifted = [f"{over(f'lag({c}, {shift})')} as {c}_{shift}" for c in columns]
    return settle(rows.selectExpr("*", *shifted)).drop("_chunk")
