"""Ticks as a stream, and bars from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.bars import _INTERVALS as INTERVALS


def stream_ticks(spark: SparkSession, folder: str, schema: str, files: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder as a stream; ``files`` is a name pattern."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)


def stream_bars(
    ticks: DataFrame,
    timeframe: str,
    price: str = "price",
    tie: str = "tick_id",
    delay: str = "0 seconds",
    distinct: bool = False,
) -> DataFrame:
    """Tumbling bars. A bar is emitted once the watermark, ``delay`` behind the latest tick, has passed its end.

    Ticks that are late by less than ``delay`` still count. With ``distinct`` a tick that arrives again (``symbol`` and
    ``tie``) within the delay is dropped, and so is each tick older than the watermark, which ``late_ticks`` counts; without
    it a late tick is dropped only if its bar is closed. ``ts`` must be TIMESTAMP. Months have no constant length and
    are left to the batch function.
    """
    if timeframe not in INTERVALS:
        raise ValueError(f"no streaming window for timeframe {timeframe!r}")
    offset = "3 days" if timeframe == "W1" else "0 seconds"
    order = F.struct("ts", tie)
    marked = ticks.withWatermark("ts", delay)
    if distinct:
        marked = marked.dropDuplicatesWithinWatermark(["symbol", tie])
    return (
        marked.groupBy("symbol", F.window("ts", INTERVALS[timeframe], INTERVALS[timeframe], offset).alias("_w"))
        .agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .select("symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def late_ticks(query: StreamingQuery) -> int:
    """Ticks that a ``distinct`` bar stream dropped as older than the watermark, by the progress the query still holds."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
        if operator["operatorName"] == "dedupeWithinWatermark"
    )
