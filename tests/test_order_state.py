import random

import numpy as np
import pandas as pd
import pytest
from conftest import random_bars

from barspark.operators import order_state as st
from barspark.operators import orders, zones
from barspark.plans import Layout, chunk_sql, number_rows
from barspark.plans import automaton as au

SMALL = Layout("H1", bucket_slots=40, chunk_rows=16, fanout=2)
INFO = dict(point=0.01, tick_value=1.0, tick_size=0.01, lot_min=0.01, lot_max=50.0, lot_step=0.01, digits=2)
EMPTY = "symbol string, ts timestamp, type string, event string"


def test_states_equal_a_walk(spark):
    rng = random.Random(2)
    rows = [(s, i + 1, n, rng.choice([None, *rng.choices(range(256), k=3)])) for s, n in (("A", 200), ("B", 1), ("C", 33)) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, rn long, n long, f int").selectExpr("*", f"{chunk_sql(SMALL)} as _chunk")
    got = {(r.symbol, r.rn): r.state for r in au.scan_states(df, "f", SMALL, start=2).collect()}
    assert len(got) == len(rows)
    state = {}
    for symbol, rn, _, f in rows:
        now = state.get(symbol, 2)
        assert got[symbol, rn] == now
        state[symbol] = now if f is None else f >> 2 * now & 3


def walk(table: pd.DataFrame, lot_positive=lambda row, kind: True):
    """Bar by bar: what is tried and reset."""
    out = []
    zone = {k: None for k in st.KINDS}
    valid, used, ticket = ({k: False for k in st.KINDS} for _ in range(3))
    for r in table.to_dict("records"):
        for k in st.KINDS:
            if r[f"{k}_gone"] and ticket[k]:
                ticket[k] = valid[k] = used[k] = False
                out.append((r["ts"], k.upper(), "RESET", zone[k]["entry"]))
            if not pd.isna(r[f"{k}_zone_ts"]):
                zone[k] = {c: r[f"{k}_{c}"] for c in zones.ZONE_COLUMNS}
                valid[k], used[k] = True, False
        for k in st.KINDS:
            if not valid[k] or used[k]:
                continue
            entry = zone[k]["entry"]
            if (r["ask"] < entry) if k == "supply" else (r["bid"] > entry):
                used[k] = True
                out.append((r["ts"], k.upper(), "SKIP", entry))
                if k == "supply":
                    break
            elif r[f"{k}_rejected"]:
                out.append((r["ts"], k.upper(), "REJECT", entry))
            else:
                used[k] = ticket[k] = True
                out.append((r["ts"], k.upper(), "PLACE", entry))
    return out


def random_zones(n, seed, symbol):
    rng = np.random.default_rng(seed)
    df = random_bars(n, symbol, seed)[["symbol", "ts"]]
    df["bid"] = np.round(100 + rng.normal(0, 1, n), 2)
    df["ask"] = df.bid + 0.02
    share = rng.choice([0.05, 0.3, 0.8])
    for k in st.KINDS:
        there = rng.random(n) < share
        df[f"{k}_zone_ts"] = df.ts.where(there)
        for c in ("upper", "lower", "entry", "sl", "tp"):
            df[f"{k}_{c}"] = np.where(there, np.round(100 + rng.normal(0, 1, n), 2), np.nan)
    return df


@pytest.mark.parametrize("rejected, gone", [(0.0, 0.0), (0.5, 0.3), (0.95, 0.1), (0.2, 0.9)])
def test_events_equal_a_walk(spark, rejected, gone):
    rng = np.random.default_rng(5)
    table = pd.concat([random_zones(n, 10 * i + int(10 * rejected), s) for i, (s, n) in enumerate((("A", 130), ("B", 70), ("C", 1)))], ignore_index=True)
    status, marks = [], {f"{k}_{e}": np.zeros(len(table), bool) for k in st.KINDS for e in ("rejected", "gone")}
    for i, r in enumerate(table.itertuples()):
        for k in st.KINDS:
            if rng.random() < rejected:
                marks[f"{k}_rejected"][i] = True
                status.append((r.symbol, r.ts, k.upper(), st.REJECTED))
            if rng.random() < gone:
                marks[f"{k}_gone"][i] = True
                # at the bar itself, or since the bar before
                late = pd.Timedelta(minutes=int(rng.integers(0, 2)) * int(rng.integers(0, 59)))
                status += [(r.symbol, r.ts - late, k.upper(), st.GONE)] * int(rng.integers(1, 3))
    status.append(("A", table[table.symbol == "A"].ts.max() + pd.Timedelta(hours=1), "SUPPLY", st.GONE))
    status.append(("A", table.ts[3], "SUPPLY", "OTHER"))
    found = number_rows(spark.createDataFrame(table), SMALL)
    feed = spark.createDataFrame([(s, t.to_pydatetime(), k, e) for s, t, k, e in status], EMPTY)
    info = spark.createDataFrame(pd.DataFrame([{"symbol": s, **INFO} for s in "ABC"]))
    got = st.order_events(found, info, "1000D", feed if status else None, layout=SMALL).toPandas()
    for symbol, part in table.assign(**marks).groupby("symbol"):
        ours = got[got.symbol == symbol]
        rows = sorted((r.ts, r.type, r.action, r.entry) for r in ours.itertuples())
        assert rows == sorted(walk(part))


def test_without_answers_as_the_plain_intents(spark):
    pdf = pd.concat([random_bars(160, "A", 1), random_bars(90, "B", 2)], ignore_index=True)
    bars = spark.createDataFrame(pdf).selectExpr("*", "open as bid", "open * 1.0002D as ask")
    found = zones.detect_zones(bars, 10, zones.ZoneLevels(sl=0.9), SMALL)
    info = spark.createDataFrame(pd.DataFrame([{"symbol": s, **INFO} for s in "AB"]))
    want = orders.order_intents(found, info, "1000D", layout=SMALL).drop("upper", "lower")
    got = st.order_events(found, info, "1000D", layout=SMALL)
    a, b = (sorted(map(str, d.select("symbol", "ts", "side", "action", "entry", "sl", "tp", "lot", "degenerate").collect())) for d in (got, want))
    assert len(a) > 20 and a == b


def test_no_rows(spark):
    pdf = random_bars(30, "A", 1)
    bars = spark.createDataFrame(pdf).selectExpr("*", "open as bid", "open as ask")
    found = zones.detect_zones(bars.limit(0), 10, layout=SMALL)
    info = spark.createDataFrame(pd.DataFrame([{"symbol": "A", **INFO}]))
    assert st.order_events(found, info, "1000D", spark.createDataFrame([], EMPTY), layout=SMALL).count() == 0
