"""Zones, trailing stops and orders as stateful processors.

State lives in the stream engine's own state store, keyed by symbol, and is versioned and restored with the checkpoint:
a repeated or restarted batch starts from the state before it. ``use_state_store`` picks the store that these need.

A task holds the new rows of its keys in one micro-batch; sources bound these (``maxFilesPerTrigger`` and the like). What
is kept between batches does not grow with the number of batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.order_state import GONE, KINDS, REJECTED, SIDES
from ..operators.orders import RISK_PERCENT, SYMBOL_INFO, degenerate_sql, lot_sql
from ..operators.trailing import stop_candidates
from ..operators.zones import LOOKBACK, ZONE_COLUMNS, ZONE_TYPES, ZoneLevels

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Bars whose look-backs are searched together.
TOGETHER = 4096


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _times(us: Iterable[int | None]) -> pd.Series:
    return pd.to_datetime(pd.Series(list(us), dtype="Int64"), unit="us")


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[us]").astype(np.int64)


# --- zones -------------------------------------------------------------------------------------


def latest_extremes(close: np.ndarray, first: int, size: int, sign: int) -> np.ndarray:
    """For the rows from ``first`` on, the place of the highest (``sign`` 1) or lowest (-1) of the ``size`` values before, the
    latest of equal ones; -1 where there is none. A highest value is above 0.
    """
    usable = (close > 0) if sign > 0 else ~np.isnan(close)
    padded = np.concatenate((np.full(size, -np.inf), np.where(usable, sign * close, -np.inf)))
    out = []
    for a in range(first, len(close), TOGETHER):
        b = min(len(close), a + TOGETHER)
        windows = np.lib.stride_tricks.sliding_window_view(padded[a : b + size - 1], size)[:, ::-1]
        back = windows.argmax(axis=1)
        at = np.arange(a, b) - 1 - back
        out.append(np.where(np.isinf(windows[np.arange(b - a), back]), -1, at))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def find_zones(bars: dict[str, np.ndarray], first: int, seen: int, lookback: int, levels: ZoneLevels) -> dict[str, pd.DataFrame]:
    """For the bars from ``first`` on, the zones of each type: ``at`` (-1: none) and the levels. ``seen`` bars came before all."""
    o, h, l, c = (bars[x] for x in ("open", "high", "low", "close"))
    out = {}
    for kind, sign in (("supply", 1), ("demand", -1)):
        at = latest_extremes(c, first, lookback, sign)
        if kind == "demand":  # needs a full look-back
            at = np.where(np.arange(first, len(c)) + seen >= lookback, at, -1)
        j, p = np.maximum(at, 0), np.maximum(at - 1, 0)
        body, before = sign * (c[j] - o[j]), sign * (c[p] - o[p])
        at = np.where((at > 0) & (body > 0) & (before > 0), at, -1)
        far, near = (l[p], h[j]) if kind == "supply" else (h[p], l[j])
        height = sign * (near - far)
        entry = near - sign * (height * levels.entry)
        sl = far + sign * (height * levels.sl)
        tp = entry - sign * (np.abs(entry - sl) * levels.reward)
        upper, lower = (near, entry) if kind == "supply" else (entry, near)
        out[kind] = pd.DataFrame({"at": at, "upper": upper, "lower": lower, "entry": entry, "sl": sl, "tp": tp})
    return out


BAR = ("open", "high", "low", "close")


class ZoneProcessor(StatefulProcessor):
    """State of a symbol: its last ``lookback + 1`` bars, how many came before these, and the zones of its last bar."""

    def __init__(self, lookback: int, levels: ZoneLevels) -> None:
        self.lookback, self.levels = lookback, levels

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getListState("bars", "us bigint, open double, high double, low double, close double")
        self.last = handle.getValueState("last", "seen bigint, supply bigint, demand bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = list(self.bars.get())
        seen, *zones = self.last.get() or (0, None, None)
        fresh = pd.concat(list(rows)).drop_duplicates("ts").sort_values("ts")
        if kept:  # a bar that is no later than the last one has been seen, or comes too late
            fresh = fresh[_micros(fresh["ts"]) > kept[-1][0]]
        if fresh.empty:
            return
        us = np.concatenate(([r[0] for r in kept], _micros(fresh["ts"]))).astype(np.int64)
        bars = {c: np.concatenate(([r[i + 1] for r in kept], fresh[c].to_numpy(float))) for i, c in enumerate(BAR)}
        first = len(kept)
        found = find_zones(bars, first, seen, self.lookback, self.levels)
        frames = []
        for k, (kind, zone) in enumerate(found.items()):
            zone_us = [None if a < 0 else int(us[a]) for a in zone["at"]]
            zone["first"] = [z is not None and z != before for z, before in zip(zone_us, [zones[k], *zone_us])]
            zone["ts"], zone["zone_ts"] = fresh["ts"].to_numpy(), _times(zone_us)
            zone["type"], zone["code"] = kind.upper(), ZONE_TYPES[kind.upper()]
            zones[k] = zone_us[-1]
            frames.append(zone[zone["at"] >= 0])
        stay = max(0, len(us) - self.lookback - 1)
        self.bars.put(list(zip(us[stay:].tolist(), *[bars[c][stay:].tolist() for c in BAR])))
        self.last.update((seen + stay, *zones))
        out = pd.concat(frames)
        out["symbol"] = key[0]
        yield out[["symbol", "ts", "type", "code", *ZONE_COLUMNS, "first"]]

    def close(self) -> None:
        pass


def zone_stream(bars: DataFrame, lookback: int = LOOKBACK, levels: ZoneLevels = ZoneLevels()) -> DataFrame:
    """Zones of a stream of closed bars: the rows of ``zone_rows(detect_zones(...))`` on the whole series.

    A symbol's bars must arrive in time order; one that is not later than the last bar seen is ignored.
    """
    levels_sql = ", ".join(f"{c} double" for c in ZONE_COLUMNS[1:])
    return (
        bars.select("symbol", "ts", *BAR)
        .groupBy("symbol")
        .transformWithStateInPandas(
            ZoneProcessor(lookback, levels),
            f"symbol string, ts timestamp, type string, code int, zone_ts timestamp, {levels_sql}, first boolean",
            "Append",
            "None",
        )
    )


# --- trailing stops ----------------------------------------------------------------------------

#: Arrays that the records of a key are dealt to by ticket.
SHELVES = 256
WAITING = np.dtype(
    [("ticket", "<i8"), ("us", "<i8"), ("buy", "?"), *((c, "<f8") for c in ("price_open", "sl", "tp", "trigger", "new_sl"))]
)
MOVED = np.dtype([("ticket", "<i8"), ("us", "<i8")])


def _shelf(tickets: np.ndarray) -> np.ndarray:
    mixed = tickets.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(32)).astype(np.int64) % SHELVES


class Shelves:
    """Records of tickets in a map state of arrays, so that a batch makes few calls whatever its number of tickets."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, kind: np.dtype) -> None:
        self.state, self.kind = handle.getMapState(name, "shelf int", "records binary"), kind

    def read(self, shelves: Iterable[int]) -> np.ndarray:
        kept = [self.state.getValue((int(k),)) for k in shelves]
        return np.concatenate([np.zeros(0, self.kind), *(np.frombuffer(k[0], self.kind) for k in kept if k)])

    def read_all(self) -> np.ndarray:
        return self.read([k for (k,) in self.state.keys()])

    def write(self, records: np.ndarray, shelves: np.ndarray) -> None:
        """Make the records those of the given shelves; what else they held is dropped."""
        place = _shelf(records["ticket"])
        order = np.argsort(place, kind="stable")
        begins, ends = (np.searchsorted(place[order], shelves, side) for side in ("left", "right"))
        for k, begin, end in zip(shelves.tolist(), begins, ends):
            if end > begin:
                self.state.updateValue((k,), (records[order[begin:end]].tobytes(),))
            elif self.state.containsKey((k,)):
                self.state.removeKey((k,))


def _positions(frame: pd.DataFrame) -> np.ndarray:
    out = np.zeros(len(frame), WAITING)
    out["us"], out["buy"] = frame["ts"].to_numpy("datetime64[ns]").astype(np.int64) // 1000, frame["type"] == "BUY"
    for c in ("ticket", "price_open", "sl", "tp", "trigger", "new_sl"):
        out[c] = frame[c].to_numpy(WAITING[c])
    return out


def _nearest(positions: np.ndarray) -> tuple[float, float]:
    """The lowest trigger of buys and the highest of sells."""
    buy = positions["buy"]
    return positions["trigger"][buy].min(initial=np.inf), positions["trigger"][~buy].max(initial=-np.inf)


class TrailingProcessor(StatefulProcessor):
    """State of a part of a symbol's positions: those that may still move, the triggers next to the price, and the
    tickets moved lately.
    """

    def __init__(self, remember_us: int) -> None:
        self.remember_us = remember_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = Shelves(handle, "waiting", WAITING)
        self.nearest = handle.getValueState("nearest", "buy double, sell double")
        self.moved = Shelves(handle, "moved", MOVED)

    def _unknown(self, opened: np.ndarray) -> np.ndarray:
        """The first of each ticket that neither waits nor has moved."""
        opened = opened[np.sort(np.unique(opened["ticket"], return_index=True)[1])]
        shelves = np.unique(_shelf(opened["ticket"]))
        known = np.concatenate([x.read(shelves)["ticket"] for x in (self.waiting, self.moved)])
        return opened[~np.isin(opened["ticket"], known)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        buy, sell = self.nearest.get() or (np.inf, -np.inf)
        parts, opened = [], [np.zeros(0, WAITING)]
        for frame in rows:
            given = frame["ticket"].isna().to_numpy()
            quotes = frame[given]
            parts.append((_micros(quotes["ts"]), quotes["bid"].to_numpy(float), quotes["ask"].to_numpy(float)))
            if not given.all():
                opened.append(_positions(frame[~given]))
        us, bid, ask = (np.concatenate(x) for x in zip(*parts))
        fresh = self._unknown(np.concatenate(opened))
        near = _nearest(fresh)
        buy, sell = min(buy, near[0]), max(sell, near[1])
        if len(us) and (np.nanmax(bid, initial=-np.inf) > buy or np.nanmin(ask, initial=np.inf) < sell):
            order = np.argsort(us, kind="stable")
            us, bid, ask = us[order], bid[order], ask[order]
            moved = self.moved.read_all()
            late = moved["us"] < us[-1] - self.remember_us
            waiting = np.concatenate((self.waiting.read_all(), fresh))
            at = np.full(len(waiting), -1)
            for side, values, sign in ((waiting["buy"], bid, 1), (~waiting["buy"], -ask, -1)):
                own = waiting[side]
                at[side] = first_beyond(values, np.searchsorted(us, own["us"], "left"), sign * own["trigger"])
            moves, to = waiting[at >= 0], us[at[at >= 0]]
            now = np.zeros(len(moves), MOVED)
            now["ticket"], now["us"] = moves["ticket"], to
            stay = waiting[at < 0]
            # what has not changed stays as it is
            changed = np.unique(_shelf(np.concatenate((fresh["ticket"], moves["ticket"]))))
            self.waiting.write(stay[np.isin(_shelf(stay["ticket"]), changed)], changed)
            changed = np.unique(_shelf(np.concatenate((moved["ticket"][late], now["ticket"]))))
            kept = np.concatenate((moved[~late], now))
            self.moved.write(kept[np.isin(_shelf(kept["ticket"]), changed)], changed)
            buy, sell = _nearest(stay)
            if len(moves):
                out = pd.DataFrame({c: moves[c] for c in ("ticket", "price_open", "sl", "tp", "new_sl")})
                out["symbol"], out["type"] = key[0], np.where(moves["buy"], "BUY", "SELL")
                out["open_ts"], out["moved_ts"] = moves["us"].astype("datetime64[us]"), to.astype("datetime64[us]")
                yield out[MOVE]
        elif len(fresh):
            shelves = np.unique(_shelf(fresh["ticket"]))
            self.waiting.write(np.concatenate((self.waiting.read(shelves), fresh)), shelves)
        self.nearest.update((float(buy), float(sell)))

    def close(self) -> None:
        pass


MOVE = ["ticket", "symbol", "type", "open_ts", "price_open", "sl", "tp", "new_sl", "moved_ts"]


def first_beyond(values: np.ndarray, since: np.ndarray, triggers: np.ndarray) -> np.ndarray:
    """For each ``since``, the first place from there on with a value above its trigger; -1 where there is none.

    A search climbs a tree of the maxima of pairs, pairs of pairs and so on, two nodes a level at most, and descends again.
    """
    lowest = np.full(1 << max(len(values) - 1, 0).bit_length(), -np.inf)
    lowest[: len(values)] = np.where(np.isnan(values), -np.inf, values)
    tree = [lowest]
    while len(tree[-1]) > 1:
        tree.append(np.maximum(tree[-1][::2], tree[-1][1::2]))
    at, height = since.astype(np.int64), np.full(len(since), -1)
    left = np.flatnonzero(at < len(lowest))
    for h, maxima in enumerate(tree):
        look = left
        for _ in range(2):  # the node, and its neighbour if it is the first of a pair
            hit = maxima[at[look]] > triggers[look]
            height[look[hit]] = h
            at[look[~hit]] += 1
            look = look[~hit]
            look = look[(at[look] % 2 == 1) & (at[look] < len(maxima))]
        left = left[height[left] < 0]
        at[left] //= 2
        left = left[at[left] < len(maxima) // 2]
    for h in range(len(tree) - 2, -1, -1):
        down = np.flatnonzero(height > h)
        at[down] *= 2
        at[down] += ~(tree[h][at[down]] > triggers[down])
    return np.where(height < 0, -1, at)


def move_stream(positions: DataFrame, quotes: DataFrame, parts: int = 1, remember_hours: int = 168) -> DataFrame:
    """Stop moves of positions and quotes that both arrive as streams, each position at most once.

    A position moves at the first quote at or after its opening that crosses its trigger, among the quotes that arrive with
    it or later. A ticket that arrives again is ignored, while it waits and for ``remember_hours`` of quotes after its move. The
    positions of a symbol are dealt to ``parts`` tasks, each of which gets all of the symbol's quotes.
    """
    part = F.pmod(F.xxhash64("ticket"), F.lit(parts)).cast("int")
    opened = stop_candidates(positions).withColumn("part", part).selectExpr(
        "symbol", "part", "open_ts as ts", "cast(ticket as bigint) as ticket", "type", "price_open", "sl", "tp", "trigger", "new_sl"
    )
    copies = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))) if parts > 1 else F.lit(0)
    given = quotes.select("symbol", copies.alias("part"), "ts", "bid", "ask")
    kinds = {"price_open": "double", "sl": "double", "tp": "double", "ticket": "bigint", "open_ts": "timestamp"}
    schema = ", ".join(f"{c} {kinds.get(c, 'timestamp' if c.endswith('ts') else 'double' if c == 'new_sl' else 'string')}" for c in MOVE)
    return (
        opened.unionByName(given, allowMissingColumns=True)
        .groupBy("symbol", "part")
        .transformWithStateInPandas(TrailingProcessor(remember_hours * 3_600_000_000), schema, "Append", "None")
    )


# --- orders ------------------------------------------------------------------------------------

ZONE_STATE = "us bigint, upper double, lower double, entry double, sl double, tp double, lot double, degenerate boolean"
EVENT = ["symbol", "ts", "type", "side", "action", "bid", "ask", *ZONE_COLUMNS, "lot", "degenerate"]


class OrderProcessor(StatefulProcessor):
    """State of a symbol, for each type: the zone, whether it is valid and unused, its order, and whether that is known to be
    gone. A timer checks the orders every ``every_ms`` milliseconds.
    """

    def __init__(self, every_ms: int) -> None:
        self.every_ms = every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.zone = {k: handle.getValueState(f"{k}_zone", ZONE_STATE) for k in KINDS}
        self.book = handle.getValueState("book", ", ".join(f"{k}_{c} boolean" for k in KINDS for c in ("waiting", "ticket", "gone")))
        self.timer = handle.getValueState("timer", "ms bigint")

    def _event(self, key, us, kind, action, zone, quote=(None, None)):
        head = [key[0], us, kind.upper(), SIDES[kind], action, *quote]
        return (*head, *zone[:6], *((None, None) if action == "RESET" else zone[6:]))

    def _frame(self, events: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(events, columns=EVENT)
        for c in ("ts", "zone_ts"):
            out[c] = _times(out[c]).to_numpy()
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        flags = list(self.book.get() or (False,) * 6)
        book = {k: flags[3 * i : 3 * i + 3] for i, k in enumerate(KINDS)}
        zone = {k: self.zone[k].get() for k in KINDS}
        events = []
        fresh = pd.concat(list(rows)).sort_values(["ts", "is_bar"], kind="stable")
        rejected = {(r.ts, r.type) for r in fresh[fresh["event"] == REJECTED].itertuples()}
        for r in fresh[fresh["event"] != REJECTED].itertuples():
            us = r.ts.value // 1000
            if not r.is_bar:
                kind = (r.type or "").lower()
                if r.event == GONE and kind in book and book[kind][1]:
                    book[kind][2] = True
                continue
            for k in KINDS:
                if not pd.isna(getattr(r, f"{k}_zone_ts")):
                    values = (getattr(r, f"{k}_{c}") for c in (*ZONE_COLUMNS[1:], "lot"))
                    at = getattr(r, f"{k}_zone_ts").value // 1000
                    zone[k] = (at, *map(float, values), bool(getattr(r, f"{k}_degenerate")))
                    book[k][0] = True
            for k in KINDS:
                if not book[k][0] or not zone[k][6] > 0:
                    continue
                passed = r.ask < zone[k][3] if k == "supply" else r.bid > zone[k][3]
                action = "SKIP" if passed else "REJECT" if (r.ts, k.upper()) in rejected else "PLACE"
                events.append(self._event(key, us, k, action, zone[k], (r.bid, r.ask)))
                if action != "REJECT":
                    book[k][0] = False
                if action == "PLACE":
                    book[k][1:] = True, False
                if k == "supply" and passed:
                    break
        self._keep(book, zone)
        if self.timer.get() is None:
            self._again(timerValues)
        if events:
            yield self._frame(events)

    def _keep(self, book, zone) -> None:
        self.book.update(tuple(x for k in KINDS for x in book[k]))
        for k in KINDS:
            if zone[k] is not None:
                self.zone[k].update(zone[k])

    def _again(self, timerValues) -> None:
        due = timerValues.getCurrentProcessingTimeInMs() + self.every_ms
        self.handle.registerTimer(due)
        self.timer.update((due,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """An order that is gone takes its type's zone with it, also one that has come since."""
        flags = list(self.book.get() or (False,) * 6)
        book = {k: flags[3 * i : 3 * i + 3] for i, k in enumerate(KINDS)}
        events = []
        for k in KINDS:
            waiting, ticket, gone = book[k]
            if ticket and gone:
                book[k] = [False, False, False]
                events.append(self._event(key, None, k, "RESET", self.zone[k].get()))
        self.book.update(tuple(x for k in KINDS for x in book[k]))
        self._again(timerValues)
        if events:
            yield self._frame(events)

    def close(self) -> None:
        pass


def order_stream(
    zones: DataFrame, symbol_info: DataFrame, balance: str, status: DataFrame, every_seconds: float = 60.0,
    risk_percent: float = RISK_PERCENT,
) -> DataFrame:
    """Attempts and resets, as ``order_state.order_events`` has them, on a stream of bars with zones and a feed of answers.

    ``zones`` has bars with ``bid``, ``ask`` and the columns ``supply_*`` and ``demand_*``; ``symbol_info`` is a table, ``status`` a stream of
    ``symbol, ts, type, event``. ``REJECTED`` must arrive with the bar of its time. ``GONE`` marks the present order; the next check, a
    processing-time timer every ``every_seconds``, then resets the zone: a zone that still waited is not attempted at later
    bars. Bars and answers must arrive in time order. A ``RESET`` has no time of its own; the lot is that of the detection.
    """
    info = symbol_info.select("symbol", *SYMBOL_INFO)
    sized = zones.join(info, "symbol")
    for k in KINDS:
        sized = sized.withColumn(f"{k}_lot", F.expr(lot_sql(f"{k}_entry", f"{k}_sl", balance, risk_percent)))
        sized = sized.withColumn(f"{k}_degenerate", F.expr(degenerate_sql(f"{k}_entry", f"{k}_sl")))
    names = [f"{k}_{c}" for k in KINDS for c in (*ZONE_COLUMNS, "lot", "degenerate")]
    bars = sized.select("symbol", "ts", F.lit(True).alias("is_bar"), "bid", "ask", *names)
    feed = status.select("symbol", "ts", F.lit(False).alias("is_bar"), "type", "event")
    kinds = dict.fromkeys(("symbol", "type", "side", "action"), "string") | {"ts": "timestamp", "zone_ts": "timestamp", "degenerate": "boolean"}
    return (
        bars.unionByName(feed, allowMissingColumns=True)
        .groupBy("symbol")
        .transformWithStateInPandas(
            OrderProcessor(int(1000 * every_seconds)),
            ", ".join(f"{c} {kinds.get(c, 'double')}" for c in EVENT),
            "Append",
            "ProcessingTime",
        )
    )


def start_rows(stream: DataFrame, folder: str, checkpoint: str, every: str | None = None):
    """Write a stream's rows as Parquet, each batch exactly once: every ``every``, or once over all available input.

    Timers fire in the batches that run when they are due, after the batch's rows. With ``every`` there are batches without
    rows too; a run over the available input has none, as timers that set themselves again would keep it going.
    """
    spark = stream.sparkSession
    use_state_store(spark)
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", folder)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(idle)
    spark.conf.set(idle, "true" if every else "false")
    try:
        return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
    finally:
        spark.conf.set(idle, before)
