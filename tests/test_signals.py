import numpy as np
import pandas as pd
import pytest
from conftest import ordered, random_bars, series

from barspark.operators import orders, trailing, zones
from barspark.plans import Layout, number_rows, settle, spread
from barspark.sources import sinks
from barspark.sources.quotes import quotes_at

SMALL = Layout("H1", bucket_slots=40, chunk_rows=128, fanout=2)
INFO = dict(point=0.01, tick_value=1.0, tick_size=0.01, lot_min=0.01, lot_max=50.0, lot_step=0.01, digits=2)


def info(spark, *symbols):
    return spark.createDataFrame(pd.DataFrame([{"symbol": s, **INFO} for s in symbols]))


def zones_by_loop(bars: pd.DataFrame, lookback: int, sl=0.382):
    """Bar by bar with absent bars reading as price 0."""
    o, h, l, c = (bars[x].to_numpy() for x in ("open", "high", "low", "close"))

    def at(a, i):
        return a[i] if i >= 0 else 0.0

    rows = []
    for t in range(len(bars)):
        hi, hi_at, lo, lo_at = 0.0, -1, np.inf, -1
        for i in range(1, lookback + 1):
            if at(c, t - i) > hi:
                hi, hi_at = at(c, t - i), i
            if at(c, t - i) < lo:
                lo, lo_at = at(c, t - i), i
        supply = demand = None
        k = t - hi_at
        if hi_at > 0 and hi > at(o, k) and at(c, k - 1) > at(o, k - 1):
            size = at(h, k) - at(l, k - 1)
            supply = (k, at(h, k) - size * 0.618, at(l, k - 1) + size * sl)
        k = t - lo_at
        if lo_at > 0 and lo < at(o, k) and at(c, k - 1) < at(o, k - 1):
            size = at(h, k - 1) - at(l, k)
            demand = (k, at(l, k) + size * 0.618, at(h, k - 1) - size * sl)
        rows.append((supply, demand))
    return rows


@pytest.mark.parametrize("lookback,seed", [(100, 1), (10, 2), (10, 3)])
def test_zones_match_the_loop(spark, lookback, seed):
    pdf = random_bars(260, seed=seed)
    got = ordered(zones.detect_zones(spark.createDataFrame(pdf), lookback, layout=SMALL))
    seen = 0
    for row, (supply, demand) in zip(got.itertuples(), zones_by_loop(pdf, lookback)):
        for have_ts, entry, sl, want in (
            (row.supply_zone_ts, row.supply_entry, row.supply_sl, supply),
            (row.demand_zone_ts, row.demand_entry, row.demand_sl, demand),
        ):
            assert pd.isna(have_ts) == (want is None)
            if want is not None:
                seen += 1
                assert have_ts == pdf.ts[want[0]]
                assert (entry, sl) == pytest.approx(want[1:], abs=1e-9)
    assert seen > 20


def test_demand_needs_the_full_look_back(spark):
    falling = [(200 - i, 201 - i, 198 - i, 199 - i) for i in range(102)]
    got = ordered(zones.detect_zones(spark.createDataFrame(series(falling)), 100, layout=SMALL))
    assert got.demand_zone_ts.notna().tolist() == [False] * 100 + [True, True]
    rising = [(i + 1, i + 3, i, i + 2) for i in range(5)]
    got = ordered(zones.detect_zones(spark.createDataFrame(series(rising)), 100, layout=SMALL))
    assert got.supply_zone_ts.notna().tolist() == [False, False, True, True, True]


def test_the_latest_of_tied_closes_wins(spark):
    bars = series([(1, 9, 1, 3), (2, 9, 1, 5), (4, 9, 1, 5), (9, 9, 1, 3), (9, 9, 1, 3)])
    got = ordered(zones.extreme_closes(spark.createDataFrame(bars), 4, SMALL))
    assert got.highest_shift[3] == 1 and got.lowest_shift[4] == 1 and got.highest_close[4] == 5
    assert got.highest_shift[4] == 2


def test_levels_of_a_supply_zone(spark):
    bars = series([(10, 12, 8, 11), (11, 18, 10, 17), (17, 18, 16, 16.5)])
    row = ordered(zones.detect_zones(spark.createDataFrame(bars), 2, layout=SMALL)).iloc[2]
    assert row.supply_upper == 18 and row.supply_lower == row.supply_entry == 18 - 10 * 0.618
    assert row.supply_sl == pytest.approx(8 + 3.82) and row.supply_first
    assert row.supply_sl == pytest.approx(row.supply_entry)
    apart = zones.detect_zones(spark.createDataFrame(bars), 2, zones.ZoneLevels(sl=0.618), SMALL)
    row = ordered(apart).iloc[2]
    assert row.supply_sl > row.supply_entry
    assert row.supply_tp == pytest.approx(row.supply_entry - 1.5 * (row.supply_sl - row.supply_entry))


def test_lot_sizes(spark):
    cases = pd.DataFrame(
        {
            "symbol": "A",
            "ts": pd.Timestamp("2024-01-01"),
            "id": [0, 1, 2, 3],
            "entry": [100.0, 100.0, 100.0, 100.0],
            "sl": [101.0, 100.0, 100.0 + 1e-13, 100000.0],
        }
    )
    got = orders.size_positions(spark.createDataFrame(cases), info(spark, "A"), "10000D").orderBy("id").toPandas()
    # 42.3 at risk over 100 points worth 1 each; degenerate twice; below the smallest lot
    assert got.lot.tolist() == pytest.approx([0.42, 50.0, 50.0, 0.01])
    assert got.degenerate.tolist() == [False, True, True, False]


def walk(rows: pd.DataFrame):
    """Supply first; a skipped sell ends the bar; demand waits."""
    out, waiting = [], None
    for r in rows.itertuples():
        if not pd.isna(r.demand_entry):
            waiting = r.demand_entry
        if not pd.isna(r.supply_entry):
            skipped = r.ask < r.supply_entry
            out.append((r.ts, "SELL_LIMIT", "SKIP" if skipped else "PLACE", r.supply_entry))
            if skipped:
                continue
        if waiting is not None:
            out.append((r.ts, "BUY_LIMIT", "SKIP" if r.bid > waiting else "PLACE", waiting))
            waiting = None
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_order_intents_match_the_walk(spark, seed):
    rng = np.random.default_rng(seed)
    pdf = random_bars(300, seed=seed)
    pdf["bid"] = pdf.open + rng.normal(0, 6, len(pdf))
    pdf["ask"] = pdf.bid + 0.1
    small = Layout("H1", bucket_slots=40, chunk_rows=32, fanout=2)
    found = zones.detect_zones(spark.createDataFrame(pdf), 8, layout=small)
    got = orders.order_intents(found, info(spark, "A"), "10000D", layout=small).toPandas()
    want = walk(ordered(found))
    have = got.sort_values(["ts", "side"], ascending=[True, False])
    assert list(zip(have.ts, have.side, have.action, have.entry)) == want
    assert {"SKIP", "PLACE"} <= {a for _, s, a, _ in want if s == "BUY_LIMIT"}


def test_last_zone_is_carried(spark):
    found = zones.detect_zones(spark.createDataFrame(random_bars(200, seed=4)), 10, layout=SMALL)
    got = ordered(zones.last_zones(found, Layout("H1", chunk_rows=16, fanout=2)))
    want = got.supply_entry.ffill()
    have = got.last_supply.map(lambda r: np.nan if r is None else r.entry).astype(float)
    np.testing.assert_array_equal(have, want)


def test_reconciliation(spark):
    tracked = spark.createDataFrame([("A", "SUPPLY", 5), ("A", "DEMAND", 6), ("B", "SUPPLY", 0)], "symbol string, zone_type string, ticket long")
    present = spark.createDataFrame([(6,), (6,), (9,)], "ticket long")
    assert [r.ticket for r in orders.stale_tickets(tracked, present).collect()] == [5]
    assert [r.ticket for r in orders.live_tickets(tracked, present).collect()] == [6]
    after = {(r.symbol, r.zone_type): (r.ticket, r.valid) for r in orders.reset_zones(tracked, present).collect()}
    assert after == {("A", "SUPPLY"): (0, False), ("A", "DEMAND"): (6, True), ("B", "SUPPLY"): (0, False)}


def test_trailing_stops_match_the_loop(spark):
    rng = np.random.default_rng(7)
    n = 400
    # quotes from microseconds to weeks apart, some at the same instant
    gaps = rng.choice([0, 3, 900, 70_000, 5_000_000, 9 * 10**9, 10**12], n)
    quotes = pd.DataFrame(
        {
            "symbol": rng.choice(["A", "A", "B"], n),
            "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(gaps), "us"),
            "bid": np.round(100 + np.cumsum(rng.normal(0, 1, n)), 2),
        }
    )
    quotes["ask"] = quotes.bid + 0.05
    at = quotes.sample(80, random_state=1)
    positions = pd.DataFrame(
        {
            "ticket": np.arange(80),
            "magic": 123456,
            "symbol": at.symbol.to_numpy(),
            "type": rng.choice(["BUY", "SELL"], 80),
            "open_ts": at.ts.to_numpy(),
            "price_open": at.bid.to_numpy(),
            "tp": 0.0,
        }
    )
    positions["sl"] = positions.price_open + rng.choice([-2.0, -0.5, 0.5, 2.0, 0.0], 80)
    positions.loc[:4, "sl"] = 0.0
    got = trailing.trailing_stops(spark.createDataFrame(positions), spark.createDataFrame(quotes)).toPandas()
    want = {}
    for p in positions.itertuples():
        sl = p.sl
        for q in quotes[(quotes.symbol == p.symbol) & (quotes.ts >= p.open_ts)].itertuples():
            d = abs(p.price_open - sl)
            if p.type == "BUY" and q.bid > p.price_open + d and p.price_open + d * 0.764 > sl:
                want.setdefault(p.ticket, (q.ts, p.price_open + d * 0.764))
                sl = p.price_open + d * 0.764
            if p.type == "SELL" and q.ask < p.price_open - d and p.price_open - d * 0.764 < sl:
                want.setdefault(p.ticket, (q.ts, p.price_open - d * 0.764))
                sl = p.price_open - d * 0.764
    assert len(want) > 15
    assert {r.ticket: (r.moved_ts, pytest.approx(r.new_sl)) for r in got.itertuples()} == want


def test_own_positions(spark):
    df = spark.createDataFrame([(1, 5, "A"), (2, 6, "A"), (3, 5, "B")], "ticket long, magic int, symbol string")
    assert [r.ticket for r in trailing.own_positions(df, 5).orderBy("ticket").collect()] == [1, 3]
    assert [r.ticket for r in trailing.own_positions(df, 5, "B").collect()] == [3]


def test_quotes_at(spark):
    rng = np.random.default_rng(3)
    quotes = pd.DataFrame(
        {
            "symbol": rng.choice(["A", "B"], 200),
            "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 10**6, 200)), "s"),
            "tick_id": np.arange(200),
            "bid": np.arange(200.0),
        }
    )
    quotes["ask"] = quotes.bid + 1
    ask_at = pd.DataFrame(
        {"symbol": rng.choice(["A", "B", "C"], 90), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(-9999, 10**6, 90), "s"), "k": range(90)}
    )
    ask_at.loc[:20, "ts"] = quotes.ts[:21]
    got = quotes_at(spark.createDataFrame(ask_at), spark.createDataFrame(quotes), bucket_seconds=5000, fanout=3)
    got = got.toPandas().sort_values("k", ignore_index=True)
    want = pd.merge_asof(ask_at.sort_values("ts"), quotes.sort_values(["ts", "tick_id"]), on="ts", by="symbol")
    want = want.sort_values("k", ignore_index=True)
    assert len(got) == 90 and (got.bid.fillna(-1) == want.bid.fillna(-1)).all()


def test_clock_nodes_have_bounded_children(spark):
    """One symbol holds all quotes, some of them microseconds apart."""
    quotes = spark.range(20_000).selectExpr(
        "'A' as symbol",
        "timestamp_micros(1704067200000000 + case when id < 15000 then id else (id - 14999) * 86400000000 end) as ts",
        "1.0D as bid",
        "1.0D as ask",
    )
    seconds = trailing._extremes(quotes, 2)
    for level in range(1, trailing.ROOT):
        most = trailing._nodes(quotes, seconds, level).selectExpr("max(size(_children)) as n").first().n
        assert most <= 1000


@pytest.mark.parametrize("size", [1, 2, 7, 30])
def test_rolling_extremes_equal_a_look_at_every_row(spark, size):
    pdf = random_bars(150, seed=size)
    pdf["close"] = (pdf.close * 2).round() / 2  # ties
    pdf.loc[[20, 21], "close"] = [-1.0, 0.0]
    layout = Layout("H1", bucket_slots=40, chunk_rows=32, fanout=2)
    bars = number_rows(spark.createDataFrame(pdf), layout).selectExpr("symbol", "ts", "rn", "n", "case when rn <> 91 then close end as close")
    rows = spread(bars, layout, back=size)
    found = zones.rolling(rows, {"hi": ("max", "case when close > 0 then struct(close, rn) end"), "lo": ("min", "struct(close, -rn as rn)")}, size)
    got = ordered(settle(found))
    closes = [None if k == 90 else c for k, c in enumerate(pdf.close)]
    for i, r in enumerate(got.itertuples()):
        own = [(c, k + 1) for k, c in enumerate(closes[:i])][-size:]
        high = max([(c, k) for c, k in own if c is not None and c > 0], default=None)
        low = min([(c is not None, c or 0, -k) for c, k in own], default=None)
        assert (None if r.hi is None else tuple(r.hi)) == high
        # a missing close sorts first, as in the expression over the whole frame
        assert (None if r.lo is None else r.lo[1]) == (None if low is None else low[2])


def test_quotes_of_trailing_stops_stay_off_the_driver(spark):
    """Spark takes the arrays of quotes for small, so no join may follow its estimate; only the widest nodes are copied."""
    ts = pd.Timestamp("2024-01-01").to_pydatetime()
    quotes = spark.createDataFrame([("A", ts, 1.0, 1.0)], "symbol string, ts timestamp, bid double, ask double")
    schema = "ticket long, symbol string, type string, open_ts timestamp, price_open double, sl double, tp double"
    rows = trailing.trailing_stops(spark.createDataFrame([(1, "A", "BUY", ts, 0.5, 0.2, 0.0)], schema), quotes)
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 9 and "BroadcastHashJoin" not in plan
    assert plan.count("Generate explode") == 3  # levels 4 and 5 on the way up, 4 on the way down
    assert [r.ticket for r in rows.collect()] == [1]


def test_quotes_of_stop_alerts_stay_off_the_driver(spark):
    """Of all joins only that with the digits of the symbols may be broadcast."""
    ts = pd.Timestamp("2024-01-01").to_pydatetime()
    quotes = spark.createDataFrame([("A", ts, 1.0, 1.0)], "symbol string, ts timestamp, bid double, ask double")
    schema = "ticket long, symbol string, type string, open_ts timestamp, price_open double, sl double, tp double"
    moves = trailing.trailing_stops(spark.createDataFrame([(1, "A", "BUY", ts, 0.5, 0.2, 0.0)], schema), quotes)
    rows = sinks.stop_alerts(moves, spark.createDataFrame([("A", 5)], "symbol string, digits int"), "H1")
    assert rows._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") <= 1
    assert rows.first().message.endswith("Ticket: 1\nSL Baru: 0.72920")
