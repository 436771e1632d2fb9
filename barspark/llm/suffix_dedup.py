"""Repeated substrings by suffix arrays over content-dealt shards.

A byte goes if a ``LENGTH``-byte string that covers it also starts elsewhere, in the same text or another.

* **Shards.** The hash of every ``ANCHOR`` bytes is computed; the home of a string is the place of the least hash in it
  (of equals the leftmost). Equal strings have the same anchor at their home, so dealing strings by that hash brings
  all copies together. Neighbouring strings with one home form a fragment of at most ``2 * LENGTH`` bytes, and only
  fragments go to shards, equal ones of a batch once, with their number.
* **Only what can repeat.** The anchors of all homes are counted; a fragment whose anchor occurs once holds nothing that
  repeats. Which anchors occur again goes out as a bitmap of at most ``MOST_BITS`` bits; a bit shared by chance only
  lets a fragment through in vain.
* **Suffix arrays.** Equal fragments of a shard are counted once more and compared byte by byte. The only fragment of an
  anchor needs no sorting: the anchor is at another place in each of its strings, so these differ, and repeat if the
  fragment does.
  The others are sorted by Larsson and Sadakane's refinement, which doubles the sorted prefix and sorts again only what
  is still tied, up to ``LENGTH`` bytes. Kasai's rule gives the common prefixes of
  neighbours, in lockstep over the fragments. Neighbours that share ``LENGTH`` bytes are one string.
* **Merging.** An anchor with many fragments is split over several shards. Their distinct strings are then looked up by
  binary search among the sorted strings of the anchor's other shards.

The homes are computed again for each of three passes, which is cheaper than to keep or shuffle them.

Null texts are empty; texts shorter than ``LENGTH`` lose nothing. Rows that repeat a text are copies of each other,
also with the same id. Every input row gives one output row. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import stage
from . import byte_runs as B
from .common import map_arrow
from .repeats import bitmap_of, listed
from .shingles import GOLD, mix

LENGTH = 200
ANCHOR = 48
#: Bytes of fragments in a shard, on average, and occurrences of an anchor beyond which it is split over shards.
SHARD = 3_000_000
SPLIT = 8192
#: Bytes of fragments in a suffix array, and one anchor's more.
ARRAY = 1_000_000


def homes(data: np.ndarray, places: np.ndarray, length: int, anchor: int):
    """The fragments of a piece: first start, last start, hash of the anchor, hash of the fragment, number of its part.

    ``places`` has where each part of a text begins, and the end.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none
    stretches = B.Stretches(data)
    hashes = stretches.windows(anchor)
    bits = np.uint64(23)  # a piece has fewer bytes
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width, span = length - anchor + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    home = (least & low).astype(np.int64)  # of the string from each place on
    part = np.searchsorted(places, np.arange(len(home)), "right") - 1
    inside = np.arange(len(home)) + length <= places[part + 1]
    change = np.flatnonzero(np.diff(home) | np.diff(part)) + 1
    first = np.concatenate(([0], change))
    last = np.concatenate((change, [len(home)])) - 1
    # the last strings of a part reach into the next one
    last = np.minimum(last, places[part[first] + 1] - length)
    real = inside[first] & (last >= first)
    first, last = first[real], last[real]
    anchors = hashes[home[first]]
    return first, last, anchors, stretches.between(first, last + length), part[first]


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def count_anchors(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    """``h`` and ``n`` of the anchors that are the home of fragments, a row for each batch."""

    def run(batch: pa.RecordBatch):
        for data, _, places, _ in B.pieces(batch.column(0), length - 1):
            _, _, anchors, _, _ = homes(data, places, length, anchor)
            h, n = np.unique(anchors, return_counts=True)
            yield {"h": pa.array(_long(h)), "n": pa.array(n)}

    return map_arrow(rows.select("text"), run, "h bigint, n bigint")


def suffix_array(
    data: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int, group: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` sorted by group and then by their first ``length`` bytes, and the 8 bytes from each place on as a number.

    ``ends`` has the end of the fragment at each place, ``group`` the number of its anchor: only strings of one anchor
    can be equal, so each anchor's suffixes are an array of their own. Larsson-Sadakane: a rank is the last place of its
    group, so groups keep their rank while others are refined, and only tied groups are sorted again.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : n + k]
    if len(group) and int(group.max()) >= 1 << 24:
        raise ValueError("a shard has fewer than 2 ** 24 anchors")
    reach = 5
    first_key = (group.astype(np.uint64) << np.uint64(40)) | (word >> np.uint64(24))
    order = np.argsort(first_key, kind="stable")
    sorted_words = first_key[order]
    last = np.flatnonzero(np.concatenate((sorted_words[1:] != sorted_words[:-1], [True])))
    sizes = np.diff(last, prepend=-1)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(last, sizes)
    tied = np.repeat(sizes > 1, sizes)
    slots, open_ = np.flatnonzero(tied), order[tied]  # places in the order, and what stands there
    while reach < length and len(open_):
        step = min(reach, length - reach)
        nxt = open_ + step
        inside = nxt < ends[open_]
        second = np.where(inside, rank[np.minimum(nxt, n - 1)] + 1, 0)
        key = rank[open_] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        key, open_ = key[by], open_[by]
        order[slots] = open_
        last = np.flatnonzero(np.concatenate((key[1:] != key[:-1], [True])))
        sizes = np.diff(last, prepend=-1)
        rank[open_] = np.repeat(slots[last], sizes)
        tied = np.repeat(sizes > 1, sizes)
        slots, open_ = slots[tied], open_[tied]
        reach += step
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    return order[wanted[order]], word


def common_prefixes(order: np.ndarray, word: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """For each place of ``order`` the bytes in common with the one before it, up to ``length``.

    Kasai: the suffix one further on shares at least one byte less with its own neighbour, provided that the old
    neighbour's next suffix is in the array and before it. ``first`` and ``last`` are the starts of the fragments, which
    are walked in lockstep; bytes are compared eight at a time.
    """
    before = np.full(len(word), -1, np.int64)
    before[order[1:]] = order[:-1]
    slot = np.full(len(word) + 1, -1, np.int64)
    slot[order] = np.arange(len(order))
    shared = np.zeros(len(word), np.int64)
    limits = [np.uint64(1) << np.uint64(8 * (8 - k)) for k in range(1, 8)]
    have, other = np.zeros(len(first), np.int64), np.full(len(first), -1, np.int64)
    by_size = np.argsort(first - last, kind="stable")  # the longest first, so that the lanes in use are a prefix
    first, sizes = first[by_size], (last - first + 1)[by_size]
    for step in range(int(sizes.max()) if len(sizes) else 0):
        lanes = int(np.searchsorted(-sizes, -step, "left"))
        place = first[:lanes] + step
        carried = slot[other[:lanes] + 1]
        holds = (other[:lanes] >= 0) & (carried >= 0) & (carried < slot[place])
        have = np.where(holds, np.maximum(have[:lanes] - 1, 0), 0)
        other = before[place]
        active = np.flatnonzero((other >= 0) & (have < length))
        while len(active):
            at = have[active]
            differ = word[np.minimum(place[active] + at, len(word) - 1)] ^ word[np.minimum(other[active] + at, len(word) - 1)]
            equal = np.full(len(active), 8)
            odd = differ != 0
            equal[odd] = sum((differ[odd] < limit).astype(np.int64) for limit in limits)
            have[active] = np.minimum(at + equal, length)
            active = active[~odd & (have[active] < length)]
        shared[place] = have
    return shared[order]


def _runs(starts: np.ndarray) -> list[dict]:
    """Runs of consecutive sorted numbers, ends exclusive."""
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    return [{"start": int(a[0]), "end": int(a[-1]) + 1} for a in np.split(starts, cut)]


FOUND = f"h bigint, d bigint, runs {B.RUNS}, single array<struct<at: bigint, low: bigint, high: bigint>>"


def _sorted_part(
    bodies: pa.Array, h: np.ndarray, d: np.ndarray, copies: np.ndarray, split: np.ndarray, anchor: np.ndarray,
    found: dict[str, list], length: int,
) -> None:
    """Add to ``found`` what the suffix arrays of these distinct fragments tell."""
    sizes = pa.compute.binary_length(bodies).to_numpy()
    data = np.frombuffer(b"".join(bodies.to_pylist()), np.uint8)
    stop = np.cumsum(sizes)
    first, last = stop - sizes, stop - length
    owner = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.flatnonzero(np.arange(len(data)) <= last[owner])
    order, word = suffix_array(data, stop[owner], starts, length, anchor[owner])
    same = common_prefixes(order, word, first, last, length) >= length
    group = np.cumsum(~same) - 1
    total = np.bincount(group, weights=copies[owner[order]])[group]
    repeats = np.sort(order[total > 1])
    # of split anchors one of each string, whether it repeats here or not: another shard may hold it once
    alone = np.sort(order[~same & split[owner[order]]])
    windows = _string_hashes(data, alone, length) if len(alone) else None
    cuts = np.searchsorted(repeats, stop), np.searchsorted(alone, stop)
    a0 = b0 = 0
    for i, (a1, b1) in enumerate(zip(*(c.tolist() for c in cuts))):
        if a1 > a0 or b1 > b0:
            found["h"].append(int(h[i]))
            found["d"].append(int(d[i]))
            found["runs"].append(_runs(repeats[a0:a1] - first[i]) if a1 > a0 else [])
            found["single"].append([
                {"at": int(alone[k] - first[i]), "low": int(windows[0][k]), "high": int(windows[1][k])} for k in range(b0, b1)
            ])
        a0, b0 = a1, b1


def _search_shard(table: pa.Table, length: int) -> pa.Table:
    """By fragment the starts of strings that repeat here; of split anchors also one start of each string."""
    table = table.sort_by([("h", "ascending"), ("d", "ascending")])
    h, d, n, split = (table[c].to_numpy() for c in ("h", "d", "n", "split"))
    fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
    cut = np.flatnonzero(fresh)
    copies = np.add.reduceat(n, cut)
    every = table["body"]
    if not pa.compute.all(pa.compute.equal(every, every.take(pa.array(cut[np.cumsum(fresh) - 1])))).as_py():
        raise ValueError("two fragments with the same 128 bits of hash differ")
    h, d, split = h[cut], d[cut], split[cut]
    anchor = np.cumsum(np.concatenate(([True], h[1:] != h[:-1]))) - 1
    alike = np.bincount(anchor)[anchor] == 1  # the only fragment of its anchor: a sorted array as it is
    found = {"h": [], "d": [], "runs": [], "single": []}
    bodies = table["body"].take(pa.array(cut)).combine_chunks()
    bodies = bodies.chunk(0) if isinstance(bodies, pa.ChunkedArray) else bodies
    sizes = pa.compute.binary_length(bodies).to_numpy()
    settled = alike & ~split
    for i in np.flatnonzero(settled & (copies > 1)).tolist():
        found["h"].append(int(h[i]))
        found["d"].append(int(d[i]))
        found["runs"].append([{"start": 0, "end": int(sizes[i]) - length + 1}])
        found["single"].append([])
    rest = np.flatnonzero(~settled)
    # whole anchors at a time, about ARRAY bytes of them
    filled = np.cumsum(sizes[rest]) // ARRAY
    group = filled[np.searchsorted(anchor[rest], anchor[rest], "left")] if len(rest) else filled
    for row in np.split(rest, np.flatnonzero(np.diff(group)) + 1):
        if len(row):
            of = np.unique(anchor[row], return_inverse=True)[1]
            _sorted_part(bodies.take(pa.array(row)), h[row], d[row], copies[row], split[row], of, found, length)
    schema = pa.schema([
        ("h", pa.int64()), ("d", pa.int64()),
        ("runs", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("single", pa.list_(pa.struct([("at", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]))),
    ])
    return pa.table(found, schema=schema)


def _string_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the string from each start on."""
    low = B.Stretches(data).windows(length)[starts]
    high = B.Stretches(data ^ np.uint8(0x5A)).windows(length)[starts]
    return _long(low), _long(mix(high ^ GOLD))


def _merge(table: pa.Table) -> pa.Table:
    """The strings of split anchors that several shards hold: each shard's sorted strings are looked up in the others'."""
    part = table["part"].to_numpy()
    both = np.zeros(table.num_rows, [("h", "<i8"), ("low", "<i8"), ("high", "<i8")])
    for c in both.dtype.names:
        both[c] = table[c].to_numpy()
    lists = {p: np.sort(both[part == p]) for p in np.unique(part).tolist()}
    hit = np.zeros(len(both), bool)
    for p, own in lists.items():
        mine = np.flatnonzero(part == p)
        for q, other in lists.items():
            if p != q:
                at = np.minimum(np.searchsorted(other, both[mine]), len(other) - 1)
                hit[mine] |= other[at] == both[mine]
    keep = table.filter(pa.array(hit))
    runs = [[{"start": a, "end": a + 1}] for a in keep["at"].to_pylist()]
    return pa.table({
        "h": keep["h"].cast(pa.int64()), "d": keep["d"].cast(pa.int64()),
        "runs": pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    })


def repeated(rows: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id``, ``text_key`` and the ``runs`` of bytes covered by repeated strings; ``rows`` as from ``keyed``."""
    if not 0 < anchor < length:
        raise ValueError("an anchor is shorter than the strings")
    spark = rows.sparkSession
    anchors = stage(
        count_anchors(rows, length, anchor).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"), "anchors"
    )
    known = anchors.agg(F.count("*").alias("n"), F.sum("n").alias("total")).first()
    split_from = max(SPLIT, (known.total or 0) >> 20)  # fewer than 2 ** 20 anchors have more
    many = anchors.where(F.col("n") > split_from).select("h", F.ceil(F.col("n") / split_from).cast("int").alias("parts"))
    bitmap = spark.sparkContext.broadcast(bitmap_of(anchors, known.n))

    def fragments(batch: pa.RecordBatch):
        for data, _, places, _ in B.pieces(batch.column(0), length - 1):
            first, last, h, d, _ = homes(data, places, length, anchor)
            keep = listed(bitmap.value, h)
            if not keep.any():
                continue
            first, last, h, d = first[keep], last[keep], h[keep], d[keep]
            both = np.stack([h, d], axis=1)
            _, at, n = np.unique(both.view([("h", "<u8"), ("d", "<u8")]).reshape(-1), return_index=True, return_counts=True)
            body = [data[a:b].tobytes() for a, b in zip(first[at].tolist(), (last[at] + length).tolist())]
            yield {"h": pa.array(_long(h[at])), "d": pa.array(_long(d[at])), "n": pa.array(n), "body": body}

    def occurrences(batch: pa.RecordBatch):
        for data, rows_of, places, bases in B.pieces(batch.column(2), length - 1):
            first, _, h, d, part = homes(data, places, length, anchor)
            keep = listed(bitmap.value, h)
            first, h, d, part = first[keep], h[keep], d[keep], part[keep]
            # one row for the like fragments of a text
            order = np.lexsort((first, d, h, part))
            first, h, d, part = first[order], h[order], d[order], part[order]
            cut = np.flatnonzero(
                np.concatenate(([True], (np.diff(part) != 0) | (h[1:] != h[:-1]) | (d[1:] != d[:-1])))[: len(h)]
            )
            at = first - places[part] + bases[part]
            owner = pa.array(rows_of[part[cut]])
            yield {
                "h": pa.array(_long(h[cut])), "d": pa.array(_long(d[cut])),
                "doc_id": batch.column(0).take(owner), "text_key": batch.column(1).take(owner),
                "at": pa.ListArray.from_arrays(pa.array(np.append(cut, len(h)).astype(np.int32)), pa.array(at)),
            }

    total = known.total or 0
    shards = max(1, -(-total * 2 * length // (3 * SHARD)))
    cut = map_arrow(rows.select("text"), fragments, "h bigint, d bigint, n bigint, body binary")
    dealt = cut.join(F.broadcast(many), "h", "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("d"), F.col("parts")), F.lit(0)).cast("int")
    ).select("h", "d", "n", "body", "part", F.col("parts").isNotNull().alias("split"))
    shard = F.pmod(F.xxhash64("h", "part"), F.lit(shards)).alias("shard")
    found = stage(
        dealt.select("*", shard).groupBy("shard").applyInArrow(lambda t: _search_shard(t, length), FOUND), "fragments"
    )
    single = found.where(F.size("single") > 0).select("h", "d", F.explode("single").alias("s")).select(
        "h", "d", "s.at", "s.low", "s.high"
    ).join(F.broadcast(many), "h").withColumn("part", F.pmod(F.xxhash64("d"), F.col("parts")).cast("int"))
    merged = single.groupBy(F.pmod(F.xxhash64("h", "low"), F.lit(16 * shards)).alias("bucket")).applyInArrow(
        _merge, f"h bigint, d bigint, runs {B.RUNS}"
    )
    repeats = found.where(F.size("runs") > 0).select("h", "d", "runs").unionByName(merged)
    places = map_arrow(
        rows.select("doc_id", "text_key", "text"), occurrences,
        "h bigint, d bigint, doc_id bigint, text_key bigint, at array<bigint>",
    )
    covered = F.flatten(F.transform("at", lambda p: F.transform("runs", lambda r: F.struct(
        (p + r["start"]).alias("start"), (p + r["end"] + (length - 1)).alias("end"),
    ))))
    return places.join(repeats, ["h", "d"]).select("doc_id", "text_key", covered.alias("runs"))


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and the bytes ``kept`` of every row."""
    rows = B.keyed(docs, id, text)
    return B.remove_runs(rows, B.gather_runs(repeated(rows, length)))
