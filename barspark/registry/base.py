"""Inputs shared by the registered queries: ticks and bars read from the given tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..plans import Layout
from ..sources.bars import to_bars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOURLY = Layout("H1")
DAILY = Layout("D1")


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is what it must equal."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """One tick per event: symbol = event type, price = value."""
    return table(spark, sf, "events").selectExpr(
        "event_type as symbol", "cast(ts as timestamp) as ts", "event_id as tick_id", "value as price"
    )


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return to_bars(ticks(spark, sf), "H1")


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    return ticks(spark, sf).selectExpr(
        "symbol", "ts", "tick_id", "price as bid", "price * 1.0002D as ask"
    )


def brand_days(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars per part brand; the price of a line is its price per unit."""
    parts = table(spark, sf, "part").selectExpr("p_partkey as l_partkey", "p_brand")
    lines = table(spark, sf, "lineitem").join(parts, "l_partkey")
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    priced = lines.selectExpr(
        "p_brand as symbol",
        "cast(l_shipdate as timestamp) as ts",
        "l_extendedprice / l_quantity as price",
        *order,
    )
    return to_bars(priced, "D1", tie=order)


def show(
    df: DataFrame,
    keys: Sequence[str] = ("symbol", "ts"),
    numbers: Sequence[str] = (),
    digits: int = 6,
    times: Sequence[str] = ("ts",),
) -> DataFrame:
    """Times as text and doubles rounded, so that two engines can be compared."""
    return df.selectExpr(
        *[f"date_format({k}, 'yyyy-MM-dd HH:mm:ss') as {k}" if k in times else f"`{k}`" for k in keys],
        *[f"round(`{c}`, {digits}) + 0D as `{c}`" for c in numbers],
    )


# --- SQL shared by the counterparts ------------------------------------------------------------

TICKS_SQL = """ticks as (
  select event_type as symbol, ts, event_id as tick_id, value as price from events)"""

BARS_SQL = (
    TICKS_SQL
    + """, bars0 as (
  select symbol, date_trunc('hour', ts) as ts,
    first(price order by ts, tick_id) as open, max(price) as high, min(price) as low,
    last(price order by ts, tick_id) as close, count(*)::double as volume
  from ticks group by 1, 2),
bars as (
  select *, row_number() over (partition by symbol order by ts) as rn,
    count(*) over (partition by symbol) as n from bars0)"""
)


def bars_sql(select: str, *ctes: str) -> str:
    return "with recursive " + ",\n".join((BARS_SQL, *ctes)) + "\n" + select


def stamp(column: str = "ts") -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') as {column.split('.')[-1]}"


def rounded(*columns: str, digits: int = 6) -> str:
    return ", ".join(f'round("{c}", {digits}) + 0.0 as "{c}"' for c in columns)
