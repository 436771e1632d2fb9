"""Null-safe numeric expressions. Missing is always NULL; NaN and infinities never leave a scan."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..plans import over


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 or missing."""
    return F.try_divide(a, b)


def finite(x: Column) -> Column:
    """NaN and +-infinity become NULL."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def to_number(x: Column) -> Column:
    """Text or number to DOUBLE, NULL where it does not parse."""
    return F.nanvl(x.try_cast("double"), F.lit(None).cast("double"))


def rolling_sql(agg: str, x: str, n: int) -> str:
    """``agg`` over the last ``n`` rows of the chunk, NULL until all ``n`` hold a value."""
    frame = f"rows between {n - 1} preceding and current row"
    return f"case when {over(f'count({x})', frame)} = {n} then {over(f'{agg}({x})', frame)} end"


def rolling_mean_sql(x: str, n: int) -> str:
    return rolling_sql("avg", x, n)


def rolling_std_sql(x: str, n: int) -> str:
    """Sample standard deviation (divisor n-1)."""
    return rolling_sql("stddev_samp", x, n)
