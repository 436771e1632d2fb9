import os
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def random_bars(rows: int, symbol: str = "A", seed: int = 0, step: str = "1h") -> pd.DataFrame:
    """A bar series with gaps in time, two-decimal prices and now and then an unchanged candle."""
    rng = np.random.default_rng(seed)
    close = np.round(100 + np.cumsum(rng.normal(0, 1, rows)), 2)
    open_ = np.round(np.where(rng.random(rows) < 0.1, close, close + rng.normal(0, 1, rows)), 2)
    slots = np.sort(rng.choice(rows * 3, rows, replace=False))
    return pd.DataFrame(
        {
            "symbol": symbol,
            "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(slots * pd.Timedelta(step)),
            "open": open_,
            "high": np.round(np.maximum(open_, close) + rng.random(rows), 2),
            "low": np.round(np.minimum(open_, close) - rng.random(rows), 2),
            "close": close,
            "volume": rng.integers(1, 9, rows).astype(float),
        }
    )


def series(prices, symbol: str = "A") -> pd.DataFrame:
    """Bars from (open, high, low, close) tuples, one per hour."""
    df = pd.DataFrame(prices, columns=["open", "high", "low", "close"], dtype=float)
    df.insert(0, "symbol", symbol)
    df.insert(1, "ts", pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(len(df)), "h"))
    df["volume"] = 1.0
    return df


def ordered(df, *keys) -> pd.DataFrame:
    return df.toPandas().sort_values(list(keys or ("symbol", "ts")), ignore_index=True)
