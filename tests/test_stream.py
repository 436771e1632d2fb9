from datetime import datetime, timedelta

import pandas as pd
from conftest import ordered, random_bars

from barspark.operators.zones import detect_zones, zone_rows
from barspark.plans import Layout
from barspark.streaming import bars as sb
from barspark.streaming import signals as ss

SMALL = Layout("H1", bucket_slots=40, chunk_rows=64, fanout=2)
START = datetime(2024, 1, 1)
TICK = "symbol string, ts timestamp, tick_id long, price double"


def arrive(spark, folder, rows):
    df = spark.createDataFrame([(s, pd.Timestamp(t).to_pydatetime(), i, p) for s, t, i, p in rows], TICK)
    df.coalesce(1).write.mode("append").parquet(folder)


def test_bars_close_with_the_watermark_and_late_ticks_are_dropped(spark, tmp_path):
    src, out, check = (str(tmp_path / p) for p in ("ticks", "bars", "check"))

    def run():
        bars = sb.stream_bars(sb.stream_ticks(spark, src, TICK), "H1")
        writer = bars.writeStream.format("parquet").option("path", out).option("checkpointLocation", check)
        writer.trigger(availableNow=True).start().awaitTermination()
        return ordered(spark.read.schema(bars.schema).parquet(out))

    arrive(spark, src, [("A", "2024-01-01 00:10", 1, 5.0), ("A", "2024-01-01 00:50", 2, 4.0), ("A", "2024-01-01 01:10", 3, 6.0)])
    first = run()
    assert first.volume.tolist() == [2] and (first.open[0], first.close[0], first.low[0]) == (5, 4, 4)
    arrive(spark, src, [("A", "2024-01-01 00:30", 4, 1.0), ("A", "2024-01-01 02:30", 5, 7.0)])
    second = run()
    assert second.ts.dt.hour.tolist() == [0, 1] and second.low.tolist() == [4, 6]


def test_zones_over_batches_equal_one_run_and_batches_repeat(spark, tmp_path):
    pdf = pd.concat([random_bars(150, "A", 1), random_bars(90, "B", 2)]).sort_values("ts")
    cuts = [0, 60, 61, 170, 240]
    sink = ss.zone_sink(str(tmp_path), 10, layout=SMALL)
    for epoch, (a, b) in enumerate(zip(cuts, cuts[1:])):
        batch = spark.createDataFrame(pdf[a:b])
        sink(batch, epoch)
        sink(batch, epoch)
    keys = ["symbol", "ts", "type"]
    got = ordered(ss.read_output(spark, str(tmp_path), "zones").drop("epoch", "first"), *keys)
    whole = detect_zones(spark.createDataFrame(pdf), 10, layout=SMALL)
    want = ordered(zone_rows(whole).drop("first"), *keys)
    assert len(want) > 20
    pd.testing.assert_frame_equal(got[want.columns], want)


def test_stops_move_once_over_batches(spark, tmp_path):
    positions = spark.createDataFrame(
        [(1, "A", "BUY", START, 10.0, 9.0, 0.0), (2, "A", "SELL", START, 10.0, 11.0, 0.0)],
        "ticket long, symbol string, type string, open_ts timestamp, price_open double, sl double, tp double",
    )
    sink = ss.trailing_sink(str(tmp_path), positions)
    prices = [[10.5, 11.5], [12.0, 8.0], [13.0, 7.0]]
    for epoch, pair in enumerate(prices):
        rows = [("A", START + timedelta(days=1, hours=2 * epoch + k), p, p) for k, p in enumerate(pair)]
        batch = spark.createDataFrame(rows, "symbol string, ts timestamp, bid double, ask double")
        sink(batch, epoch)
        sink(batch, epoch)  # a repeated batch overwrites its own result
    moved = ss.read_output(spark, str(tmp_path), "moves").orderBy("ticket").toPandas()
    assert moved.ticket.tolist() == [1, 2] and moved.epoch.tolist() == [0, 1]
    assert moved.new_sl.tolist() == [10.764, 9.236]


def test_reconciliation_sink(spark, tmp_path):
    tracked = spark.createDataFrame([(1,), (2,)], "ticket long")
    ss.reconcile_sink(str(tmp_path), tracked, lambda: tracked.filter("ticket = 2"))(tracked, 0)
    assert [r.ticket for r in ss.read_output(spark, str(tmp_path), "stale").collect()] == [1]


def test_zone_state_is_bounded_whatever_the_history(spark, tmp_path):
    pdf = random_bars(400, "A", 3)
    sink = ss.zone_sink(str(tmp_path), 10, layout=SMALL)
    for epoch, a in enumerate(range(0, 400, 200)):
        sink(spark.createDataFrame(pdf[a : a + 200]), epoch)
        assert spark.read.parquet(f"{tmp_path}/zone_state/epoch={epoch}").count() == 12


def test_late_and_repeated_ticks(spark, tmp_path):
    """With a delay of an hour: late by less, late by more, and a tick that comes twice."""
    src, out, check = (str(tmp_path / p) for p in ("ticks", "bars", "check"))

    def run():
        bars = sb.stream_bars(sb.stream_ticks(spark, src, TICK), "H1", delay="1 hour", distinct=True)
        writer = bars.writeStream.format("parquet").option("path", out).option("checkpointLocation", check)
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return sb.late_ticks(query), ordered(spark.read.schema(bars.schema).parquet(out))

    arrive(spark, src, [("A", "2024-01-01 00:50", 1, 5.0), ("A", "2024-01-01 00:50", 1, 5.0), ("A", "2024-01-01 02:10", 2, 6.0)])
    late, _ = run()
    assert late == 0
    arrive(spark, src, [("A", "2024-01-01 01:30", 3, 1.0), ("A", "2024-01-01 00:55", 4, 9.0), ("A", "2024-01-01 02:10", 2, 6.0), ("A", "2024-01-01 05:00", 5, 7.0)])
    late, bars = run()
    assert late == 1
    assert bars.ts.dt.hour.tolist() == [0, 1, 2] and bars.volume.tolist() == [1, 1, 1] and bars.high.tolist() == [5, 1, 6]
