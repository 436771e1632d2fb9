"""Cleaning and checks on raw text rows made from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean
from ..operators.indicators import add
from .base import HOURLY, bars_sql, hourly, query, rounded, show, stamp, table
from ..plans import number_rows, stage

OHLCV = ["open", "high", "low", "close", "volume"]

# unreadable times, missing and unreadable numbers, NaN and infinity, by position in the file
_FIELDS = {
    "ts": "case when event_id % 11 = 0 then 'no time' else {stamp} end",
    "open": "case when event_id % 13 = 0 then 'n/a' else cast(value as {text}) end",
    "high": "case when event_id % 17 = 0 then null else cast(value + 1 as {text}) end",
    "low": "case when event_id % 19 = 0 then 'NaN' else cast(value - 1 as {text}) end",
    "close": "case when event_id % 23 = 0 then 'Infinity' else cast(value as {text}) end",
    "volume": "cast(user_id as {text})",
}


def _select(stamp_sql: str, text: str) -> list[str]:
    return [f"{sql.format(stamp=stamp_sql, text=text)} as {c}" for c, sql in _FIELDS.items()]


def raw(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "event_type as symbol", "event_id", *_select("date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "string")
    )


_RAW = f"""with raw as (select event_type as symbol, event_id,
  {', '.join(_select("strftime(ts, '%Y-%m-%d %H:%M:%S')", "varchar"))} from events),
typed as (select symbol, event_id, try_cast(ts as timestamp) as ts, {', '.join(
    f"case when isnan(try_cast({c} as double)) then null else try_cast({c} as double) end as {c}"
    for c in OHLCV)} from raw)"""

_NULL = " or ".join(f"{c} is null" for c in OHLCV)
_INF = " or ".join(f"isinf({c})" for c in OHLCV)


@query("coerce_time", f"{_RAW} select event_id, {stamp()} from typed where ts is not null")
def coerce_time(spark, sf):
    return show(clean.coerce_time(raw(spark, sf)), ["event_id", "ts"])


@query(
    "coerce_numeric",
    f"{_RAW} select event_id, {', '.join(f'round(case when isinf({c}) then -1 else {c} end, 6) + 0.0 as {c}' for c in OHLCV)} from typed",
)
def coerce_numeric(spark, sf):
    df = clean.coerce_numeric(raw(spark, sf))
    shown = {c: f"case when {c} = double('infinity') then -1D else {c} end" for c in OHLCV}
    return show(df.selectExpr("event_id", *[f"{s} as {c}" for c, s in shown.items()]), ["event_id"], OHLCV)


@query(
    "drop_null",
    f"{_RAW} select event_id, round(open, 6) + 0.0 as open from typed where not ({_NULL})",
)
def drop_null(spark, sf):
    return show(clean.drop_null(clean.coerce_numeric(raw(spark, sf))), ["event_id"], ["open"])


@query(
    "drop_inf",
    f"{_RAW} select event_id, {rounded(*OHLCV)} from typed where not ({_NULL}) and not ({_INF})",
)
def drop_inf(spark, sf):
    return show(clean.drop_inf(clean.coerce_numeric(raw(spark, sf)), OHLCV), ["event_id"], OHLCV)


@query(
    "clean_bars",
    f"{_RAW} select event_id, {stamp()}, round(low, 6) + 0.0 as low from typed where ts is not null and not ({_NULL})",
)
def clean_rows(spark, sf):
    return show(clean.clean_bars(raw(spark, sf)), ["event_id", "ts"], ["low"])


@query(
    "quality_report",
    f"""{_RAW} select symbol, count(*) as rows, count(*) filter (ts is null) as bad_time,
  count(*) filter (ts is not null and ({_NULL})) as null_values,
  count(*) filter (ts is not null and not ({_NULL}) and ({_INF})) as infinite_values,
  count(*) filter (ts is not null and not ({_NULL}) and not ({_INF})) as kept
from typed group by symbol""",
)
def quality(spark, sf):
    return clean.quality_report(raw(spark, sf))


@query(
    "quality_in_flight",
    f"""{_RAW} select count(*) as rows, count(*) filter (ts is null) as bad_time,
  count(*) filter (ts is not null and ({_NULL})) as null_values,
  count(*) filter (ts is not null and not ({_NULL}) and ({_INF})) as infinite_values,
  count(*) filter (ts is not null and not ({_NULL}) and not ({_INF})) as kept,
  round(sum(low) filter (ts is not null and not ({_NULL}) and not ({_INF})), 4) + 0.0 as low
from typed""",
)
def quality_in_flight(spark, sf):
    """The counts of a cleaning run, made while it writes its rows."""
    cleaned, seen = clean.clean_counted(raw(spark, sf))
    rows = stage(cleaned, "cleaned")
    counts = [F.lit(seen.get[c]).cast("bigint").alias(c) for c in ("rows", *clean.REASONS, "kept")]
    return rows.agg(F.sum("low").alias("low")).select(*counts, F.expr("round(low, 4) + 0D as low"))


@query(
    "duplicate_bars",
    """select l_partkey::varchar as symbol, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') as ts, count(*) as copies
from lineitem group by 1, 2 having count(*) > 1""",
)
def duplicates(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "cast(l_partkey as string) as symbol", "cast(l_shipdate as timestamp) as ts"
    )
    return show(clean.duplicate_bars(rows), ["symbol", "ts", "copies"])


@query(
    "require_columns",
    bars_sql(f"select symbol, {stamp()}, {rounded('close')} from bars"),
)
def required(spark, sf):
    return show(clean.require_columns(hourly(spark, sf), ["symbol", "ts", *OHLCV]), numbers=["close"])


@query(
    "require_rows",
    """select p_brand as symbol, count(distinct date_trunc('day', l_shipdate)) as rows,
  count(distinct date_trunc('day', l_shipdate)) - 1500 - 30 + 1 as samples,
  count(distinct date_trunc('day', l_shipdate)) - 1500 - 30 + 1 > 0 as enough
from lineitem join part on l_partkey = p_partkey group by 1""",
)
def minimum_rows(spark, sf):
    from .base import brand_days

    return clean.require_rows(brand_days(spark, sf), 1500, 30)


@query(
    "keep_long_series",
    bars_sql(f"select symbol, {stamp()}, {rounded('close')} from bars where n - 600 - 75 + 1 > 0"),
)
def long_series(spark, sf):
    rows = number_rows(hourly(spark, sf), HOURLY)
    return show(clean.keep_long_series(rows, 600, 75), numbers=["close"])


@query(
    "series_position",
    bars_sql(f"select symbol, {stamp()}, rn, n from bars"),
)
def series_position(spark, sf):
    return show(number_rows(hourly(spark, sf), HOURLY), ["symbol", "ts", "rn", "n"])


@query(
    "safe_div",
    "select event_id, round(value / nullif(user_id % 3, 0), 6) + 0.0 as ratio from events",
)
def safe_division(spark, sf):
    from pyspark.sql import functions as F

    from ..functions.safe import safe_div

    rows = table(spark, sf, "events").withColumn("ratio", safe_div(F.col("value"), F.expr("user_id % 3")))
    return show(rows, ["event_id"], ["ratio"])


@query(
    "valid_pairs",
    """select event_id, round(y_true, 6) + 0.0 as y_true, round(y_pred, 6) + 0.0 as y_pred from (
  select event_id, case when event_id % 5 = 0 then 'NaN'::double else value end as y_true,
    case when event_id % 7 = 0 then 'Infinity'::double else value * 2 end as y_pred from events)
where event_id % 5 <> 0 and event_id % 7 <> 0""",
)
def finite_pairs(spark, sf):
    rows = add(
        table(spark, sf, "events"),
        y_true="case when event_id % 5 = 0 then double('NaN') else value end",
        y_pred="case when event_id % 7 = 0 then double('Infinity') else value * 2 end",
    )
    return show(clean.valid_pairs(rows), ["event_id"], ["y_true", "y_pred"])
