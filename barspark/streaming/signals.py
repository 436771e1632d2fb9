"""Zones, trailing stops and order reconciliation on micro-batches.

Each sink runs the batch operator on the new rows and the little state it needs. State and output live in
folders named after the batch id, so a batch that is repeated after a failure overwrites its own result
and reads the state of the batch before it.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.orders import stale_tickets
from ..operators.trailing import trailing_stops
from ..operators.zones import LOOKBACK, ZoneLevels, detect_zones, zone_rows
from ..plans import Layout, join_salted, number_rows

Sink = Callable[[DataFrame, int], None]


def _batch_path(folder: str, kind: str, epoch: int) -> str:
    return os.path.join(folder, kind, f"epoch={epoch}")


def read_output(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return spark.read.option("basePath", os.path.join(folder, kind)).parquet(os.path.join(folder, kind))


def zone_sink(
    folder: str,
    lookback: int = LOOKBACK,
    levels: ZoneLevels = ZoneLevels(),
    layout: Layout = Layout(),
) -> Sink:
    """``foreachBatch`` function for a stream of closed bars: writes ``zones``.

    State: the last ``lookback + 2`` bars of each symbol with their positions, so later batches see
    the same neighbours as one run over the whole series. Bars must arrive in time order.
    """
    columns = ["symbol", "ts", "open", "high", "low", "close", "rn"]

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = number_rows(batch.select(*columns[:-1]), layout)
        if epoch == 0:
            history = fresh.limit(0).select(*columns)
        else:
            history = spark.read.parquet(_batch_path(folder, "zone_state", epoch - 1))
        known = history.groupBy("symbol").agg(F.max("rn").alias("_known"))
        shifted = join_salted(fresh, known, ["symbol"], "rn").withColumn(
            "rn", F.col("rn") + F.coalesce("_known", F.lit(0))
        )
        rows = history.withColumn("_new", F.lit(False)).unionByName(
            shifted.select(*columns, F.lit(True).alias("_new"))
        )
        ends = rows.groupBy("symbol").agg(F.max("rn").alias("n"))
        rows = join_salted(rows, ends, ["symbol"], "rn")
        found = detect_zones(rows, lookback, levels, layout).filter("_new")
        zone_rows(found).write.mode("overwrite").parquet(_batch_path(folder, "zones", epoch))
        rows.filter(F.col("rn") > F.col("n") - (lookback + 2)).select(*columns).write.mode(
            "overwrite"
        ).parquet(_batch_path(folder, "zone_state", epoch))

    return run


def trailing_sink(folder: str, positions: DataFrame) -> Sink:
    """``foreachBatch`` function for a stream of quotes: writes ``moves``.

    State: the tickets moved in earlier batches. A position moves at most once, and a batch reports the
    first crossing among its quotes, so quotes must arrive in time order across batches.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        waiting = positions
        if epoch > 0:
            moved = read_output(spark, folder, "moves").filter(F.col("epoch") < epoch).select("ticket")
            waiting = positions.join(moved, "ticket", "left_anti")
        trailing_stops(waiting, batch).write.mode("overwrite").parquet(
            _batch_path(folder, "moves", epoch)
        )

    return run


def reconcile_sink(folder: str, tracked: DataFrame, open_orders: Callable[[], DataFrame]) -> Sink:
    """``foreachBatch`` function run on a timer: writes the tickets that are gone as ``stale``.

    ``open_orders`` is called in every batch to read the present orders.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        stale_tickets(tracked, open_orders()).write.mode("overwrite").parquet(
            _batch_path(folder, "stale", epoch)
        )

    return run


def start(
    stream: DataFrame, sink: Sink, checkpoint: str, every: str | None = None
):
    """Start a sink: every ``every`` (e.g. ``"60 seconds"``), or once over all available input."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()
