"""Small tables: account balance, symbol constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.clean import require_columns
from ..plans import join_salted

SYMBOL_INFO_COLUMNS = (
    "symbol", "point", "tick_value", "tick_size", "lot_min", "lot_max", "lot_step", "digits",
)


def symbol_info(df: DataFrame) -> DataFrame:
    """Validated symbol constants, one row per symbol."""
    return require_columns(df, SYMBOL_INFO_COLUMNS).select(*SYMBOL_INFO_COLUMNS)


def with_symbol_info(df: DataFrame, info: DataFrame, by: str = "ts") -> DataFrame:
    """Add the constants of each row's symbol."""
    return join_salted(df, symbol_info(info), ["symbol"], by)


def account_balance(accounts: DataFrame, account_id: int) -> str:
    """Balance of one account as a SQL literal for the sizing functions."""
    row = accounts.filter(F.col("account_id") == account_id).select("balance").first()
    if row is None:
        raise ValueError(f"no account {account_id}")
    return f"{float(row['balance'])!r}D"


def risk_amount(accounts: DataFrame, risk_percent: float) -> DataFrame:
    """Money at risk per trade for every account."""
    return accounts.withColumn("risk_amount", F.col("balance") * F.lit(risk_percent / 100.0))
