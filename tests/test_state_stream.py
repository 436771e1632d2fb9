"""Stateful processors against the batch operators, over several runs from one checkpoint."""

import time

import numpy as np
import pandas as pd
import pytest
from conftest import ordered, random_bars

from barspark.operators import order_state, trailing
from barspark.operators.zones import ZoneLevels, detect_zones, zone_rows
from barspark.plans import Layout
from barspark.streaming import state as st

SMALL = Layout("H1", bucket_slots=40, chunk_rows=64, fanout=2)
INFO = dict(point=0.01, tick_value=1.0, tick_size=0.01, lot_min=0.01, lot_max=50.0, lot_step=0.01, digits=2)
POSITION = "ticket long, symbol string, type string, open_ts timestamp, price_open double, sl double, tp double"
QUOTE = "symbol string, ts timestamp, bid double, ask double"
STATUS = "symbol string, ts timestamp, type string, event string"


def arrive(spark, folder, rows, schema=None):
    df = spark.createDataFrame(rows, schema) if schema else spark.createDataFrame(rows)
    df.coalesce(1).write.mode("append").parquet(folder)
    return df.schema


def source(spark, folder, schema):
    return spark.readStream.schema(schema).parquet(folder)


def run(stream, tmp_path, name="out"):
    st.start_rows(stream, f"{tmp_path}/{name}", f"{tmp_path}/check-{name}").awaitTermination()


@pytest.mark.parametrize("lookback", [1, 10])
def test_zones_over_runs_equal_one_run(spark, tmp_path, lookback):
    pdf = pd.concat([random_bars(150, "A", 1), random_bars(90, "B", 2)]).sort_values("ts")
    pdf.loc[pdf.index[30], "close"] = -1.0
    for a, b in ((0, 60), (60, 61), (61, 170), (165, 240)):  # the last part repeats some bars
        schema = arrive(spark, f"{tmp_path}/in", pdf[a:b])
        run(st.zone_stream(source(spark, f"{tmp_path}/in", schema), lookback), tmp_path)
    keys = ["symbol", "ts", "type"]
    got = ordered(spark.read.parquet(f"{tmp_path}/out"), *keys)
    want = ordered(zone_rows(detect_zones(spark.createDataFrame(pdf), lookback, layout=SMALL)), *keys)
    assert len(want) > 20
    pd.testing.assert_frame_equal(got[want.columns], want)
    assert not list(tmp_path.glob("zone_state*"))


def random_market(seed, quotes=400, positions=60):
    rng = np.random.default_rng(seed)
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.choice(100_000, quotes, replace=False)), "s")
    bid = np.round(100 + np.cumsum(rng.normal(0, 0.5, quotes)), 2)
    q = pd.DataFrame({"symbol": rng.choice(["A", "B"], quotes, p=[0.8, 0.2]), "ts": ts, "bid": bid, "ask": bid + 0.03})
    at = rng.integers(0, quotes, positions)
    side = rng.choice(["BUY", "SELL", "OTHER"], positions, p=[0.45, 0.45, 0.1])
    risk = np.round(rng.random(positions) * 3, 2)
    p = pd.DataFrame(
        {
            "ticket": np.arange(positions) + 1, "symbol": q.symbol.to_numpy()[at], "type": side,
            "open_ts": ts[at] + pd.to_timedelta(rng.integers(0, 2, positions) * 500, "ms"), "price_open": bid[at],
            "sl": bid[at] - np.where(side == "BUY", 1, -1) * risk, "tp": 0.0,
        }
    )
    return p, q


@pytest.mark.parametrize("parts", [1, 3])
def test_stops_of_positions_that_open_on_the_way(spark, tmp_path, parts):
    positions, quotes = random_market(parts)
    edges = [0, 120, 121, 300, 400]
    for a, b in zip(edges, edges[1:]):
        low = pd.Timestamp.min if a == 0 else quotes.ts[a]
        high = pd.Timestamp.max if b == 400 else quotes.ts[b]
        own = positions[(positions.open_ts >= low) & (positions.open_ts < high)]
        again = positions[positions.open_ts < low].head(5)  # tickets that come once more
        arrive(spark, f"{tmp_path}/positions", pd.concat([own, again]), POSITION)
        arrive(spark, f"{tmp_path}/quotes", quotes[a:b], QUOTE)
        streams = (source(spark, f"{tmp_path}/{n}", x) for n, x in (("positions", POSITION), ("quotes", QUOTE)))
        run(st.move_stream(*streams, parts=parts), tmp_path)
    got = ordered(spark.read.parquet(f"{tmp_path}/out"), "ticket")
    want = ordered(trailing.trailing_stops(spark.createDataFrame(positions, POSITION), spark.createDataFrame(quotes, QUOTE)), "ticket")
    assert len(want) > 10
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)


def test_a_batch_that_is_repeated_moves_nothing_twice(spark, tmp_path):
    positions, quotes = random_market(7)
    arrive(spark, f"{tmp_path}/positions", positions, POSITION)
    for a, b in ((0, 200), (200, 400)):
        arrive(spark, f"{tmp_path}/quotes", quotes[a:b], QUOTE)
        streams = [source(spark, f"{tmp_path}/{n}", x) for n, x in (("positions", POSITION), ("quotes", QUOTE))]
        run(st.move_stream(*streams), tmp_path)
    before = ordered(spark.read.parquet(f"{tmp_path}/out"), "ticket")
    # as after a failure between the output and the commit of the last batch
    commits = sorted((tmp_path / "check-out" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    crc = commits[-1].with_name(f".{commits[-1].name}.crc")
    crc.unlink(missing_ok=True)
    run(st.move_stream(*[source(spark, f"{tmp_path}/{n}", x) for n, x in (("positions", POSITION), ("quotes", QUOTE))]), tmp_path)
    pd.testing.assert_frame_equal(ordered(spark.read.parquet(f"{tmp_path}/out"), "ticket"), before)
    assert before.ticket.is_unique


def zone_bars(spark, pdf):
    bars = spark.createDataFrame(pdf).selectExpr("*", "open as bid", "open * 1.0002D as ask")
    return detect_zones(bars, 10, ZoneLevels(sl=0.9), SMALL).orderBy("ts").drop("rn", "n")


def test_orders_without_checks_equal_the_batch(spark, tmp_path):
    pdf = pd.concat([random_bars(120, "A", 1), random_bars(80, "B", 2)], ignore_index=True).sort_values("ts")
    found = zone_bars(spark, pdf).toPandas()
    status = found[found.index % 3 == 0][["symbol", "ts"]].assign(type=["SUPPLY", "DEMAND"][0], event=order_state.REJECTED)
    status = pd.concat([status, status[::2].assign(type="DEMAND")])
    info = spark.createDataFrame(pd.DataFrame([{"symbol": s, **INFO} for s in "AB"]))
    schema = zone_bars(spark, pdf).schema
    for a, b in ((0, 70), (70, 130), (130, 200)):
        part = found[a:b]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/bars")
        arrive(spark, f"{tmp_path}/status", status[status.ts.isin(part.ts)], STATUS)
        run(
            st.order_stream(source(spark, f"{tmp_path}/bars", schema), info, "1000D", source(spark, f"{tmp_path}/status", STATUS), 3600),
            tmp_path,
        )
    batch = order_state.order_events(
        zone_bars_numbered(spark, found, schema), info, "1000D", spark.createDataFrame(status, STATUS), layout=SMALL
    )
    keys = ["symbol", "ts", "type"]
    got, want = ordered(spark.read.parquet(f"{tmp_path}/out"), *keys), ordered(batch, *keys)
    assert {"REJECT", "PLACE", "SKIP"} <= set(want.action)
    pd.testing.assert_frame_equal(got[want.columns], want)


def zone_bars_numbered(spark, found, schema):
    from barspark.plans import number_rows

    return number_rows(spark.createDataFrame(found, schema), SMALL)


def test_two_timers_reset_zones_for_later_bars(spark, tmp_path):
    """A placed order is gone and the zone that waits is reset; one period later the next order is checked as well."""
    columns = ["zone_ts", "upper", "lower", "entry", "sl", "tp"]
    kinds = ", ".join(f"{k}_{c} {'timestamp' if c == 'zone_ts' else 'double'}" for k in ("supply", "demand") for c in columns)
    schema = f"symbol string, ts timestamp, bid double, ask double, {kinds}"
    info = spark.createDataFrame(pd.DataFrame([{"symbol": "A", **INFO}]))
    none = (None,) * 6

    def bar(hour, supply=False, price=9.0):
        ts = pd.Timestamp("2024-01-01") + pd.Timedelta(hours=hour)
        zone = (ts.to_pydatetime(), 11.0, 10.0, 8.0, 12.0, 6.0) if supply else none
        return ("A", ts.to_pydatetime(), price, price, *zone, *none)

    def feed(hour, event):
        return ("A", (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=hour)).to_pydatetime(), "SUPPLY", event)

    st.use_state_store(spark)
    for folder, x in (("bars", schema), ("status", STATUS)):
        spark.createDataFrame([], x).write.parquet(f"{tmp_path}/{folder}")
    stream = st.order_stream(source(spark, f"{tmp_path}/bars", schema), info, "1000D", source(spark, f"{tmp_path}/status", STATUS), 1)
    query = st.start_rows(stream, f"{tmp_path}/out", f"{tmp_path}/check", "200 milliseconds")

    def actions():
        rows = ordered(spark.read.schema(stream.schema).parquet(f"{tmp_path}/out"), "ts")
        return [(r.action, None if pd.isna(r.ts) else r.ts.hour) for r in rows.itertuples()]

    def wait_for(action, count):
        until = time.time() + 60
        while sum(a == action for a, _ in actions()) < count and time.time() < until:
            time.sleep(0.3)

    try:
        # placed at 1, then a new zone at 2 is rejected and waits; its predecessor's order is gone
        arrive(spark, f"{tmp_path}/status", [feed(2, "REJECTED"), feed(3, "GONE")], STATUS)
        arrive(spark, f"{tmp_path}/bars", [bar(1, True), bar(2, True)], schema)
        wait_for("RESET", 1)
        arrive(spark, f"{tmp_path}/bars", [bar(4), bar(5, True)], schema)  # nothing waits any more at 4
        wait_for("PLACE", 2)
        arrive(spark, f"{tmp_path}/status", [feed(6, "GONE")], STATUS)
        wait_for("RESET", 2)
        arrive(spark, f"{tmp_path}/bars", [bar(7), bar(8, True, 7.0)], schema)
        wait_for("SKIP", 1)
        got = actions()
    finally:
        query.stop()
    want = [("PLACE", 1), ("REJECT", 2), ("RESET", None), ("PLACE", 5), ("RESET", None), ("SKIP", 8)]
    assert sorted(got, key=str) == sorted(want, key=str)


class CountedState:
    """A state store in memory that counts the calls."""

    def __init__(self):
        self.calls, self.states = 0, {}

    def getMapState(self, name, key, value):
        return CountedMap(self, self.states.setdefault(name, {}))

    def getValueState(self, name, schema):
        return CountedValue(self, self.states.setdefault(name, {}))


class CountedMap:
    def __init__(self, store, rows):
        self.store, self.rows = store, rows

    def __getattribute__(self, name):
        if name not in ("store", "rows"):
            self.store.calls += 1
        return object.__getattribute__(self, name)

    def getValue(self, key):
        return self.rows.get(key)

    def containsKey(self, key):
        return key in self.rows

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]

    def keys(self):
        return iter(list(self.rows))

    def iterator(self):
        return iter(list(self.rows.items()))


class CountedValue(CountedMap):
    def get(self):
        return self.rows.get(0)

    def update(self, value):
        self.rows[0] = value


def test_calls_to_the_state_store_do_not_grow_with_positions():
    rng = np.random.default_rng(3)
    n, quotes = 6000, 900
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(quotes), "s")
    bid = np.round(100 + rng.normal(0, 3, quotes), 2)
    given = pd.DataFrame({"ts": ts, "ticket": np.nan, "type": None, "bid": bid, "ask": bid + 0.05})
    buy, at, risk = rng.random(n) < 0.5, rng.integers(0, quotes, n), rng.choice([1.0, 4.0, 50.0], n)
    sign = np.where(buy, 1, -1)
    opened = pd.DataFrame(
        {
            "ts": ts[at], "ticket": np.arange(n) + 1.0, "type": np.where(buy, "BUY", "SELL"), "price_open": bid[at],
            "sl": bid[at] - sign * risk, "tp": 0.0, "trigger": bid[at] + sign * risk, "new_sl": bid[at] + sign * risk * 0.764,
        }
    )
    store = CountedState()
    processor = st.TrailingProcessor(10**12)
    processor.init(store)
    got = []
    for k in range(3):  # the positions of the last batch have come before
        batch = pd.concat([given[300 * k : 300 * k + 300], opened[(at // 300 == k) | (k == 2) & (at < 50)]])
        got += list(processor.handleInputRows(("A", 0), iter([batch[:200], batch[200:]]), None))
    assert store.calls < n
    moves = pd.concat(got).sort_values("ticket")
    want = {}
    for r in opened.itertuples():
        first = [t for t, b in zip(ts[ts >= r.ts], bid[ts >= r.ts]) if (b > r.trigger if r.type == "BUY" else b + 0.05 < r.trigger)][:1]
        want.update({int(r.ticket): t for t in first})
    assert 1000 < len(want) < n - 1000
    assert dict(zip(moves.ticket, moves.moved_ts)) == want


@pytest.mark.parametrize("size", [0, 1, 2, 3, 8, 9, 257])
def test_first_places_beyond_triggers(size):
    rng = np.random.default_rng(size)
    values = np.round(rng.normal(0, 3, size), 1)
    values[rng.integers(0, 5, size) == 0] = np.nan
    since, triggers = rng.integers(0, size + 1, 300), np.round(rng.normal(2, 4, 300), 1)
    want = [next((i for i in range(a, size) if values[i] > t), -1) for a, t in zip(since, triggers)]
    assert st.first_beyond(values, since, triggers).tolist() == want
