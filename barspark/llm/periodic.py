"""Periodic runs: stretches of words that repeat with a period, found in enhanced suffix arrays.

A run is a longest stretch in which words ``period`` apart are identical, for its smallest period. For every text an array
of its suffixes (by words), the inverse and the longest common prefixes of neighbours are built; texts of a slice are done
together, their suffixes never compared with each other. The common prefixes part the array into intervals of suffixes
that share ``depth`` words. For each suffix ``i`` in all children of an interval but the largest, ``i + depth`` and
``i - depth`` are looked up in the inverse array: one that lies in another child of the interval makes a square that no
rotation to the right keeps. Each such square is rotated to the left as far as it goes; squares that a run with a
divisor of their period covers are merged into it. No tree is built, and a text costs ``O(n log n)`` lookups.

Rows stay where they are. A task holds one slice of texts at a time: about ``SLICE`` bytes, unless one text is longer, which
is worked on whole (some hundred bytes a word).

Null, empty and blank texts have no words and no runs, and collapse to an empty text; repeated rows and null ids are
treated like any other, and an empty table gives no rows. Of runs that overlap all are reported. Columns of ``df`` that
have the name of a result are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_arrow, text_slices, with_text_last

#: Bytes of text that are worked on together, and array entries that are looked up together.
SLICE, HELD = 1_000_000, 2_000_000
#: Words by which neighbours are compared in arrays; longer common prefixes are counted on text by text.
SHORT = 16
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def suffix_array(words: np.ndarray, text: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes, sorted within their texts, and the place of each; only groups not yet parted are sorted again.

    ``text`` is the number of the text of each word, ``end`` where it ends.
    """
    n = len(words)
    key = text * (int(words.max()) + 1) + words
    suffixes = np.argsort(key, kind="stable")
    place = np.empty(n, np.int64)
    slots, sorted_key, order, size = np.arange(n), key[suffixes], suffixes, 1
    while True:
        fresh = np.ones(len(slots), bool)
        fresh[1:] = sorted_key[1:] != sorted_key[:-1]
        place[order] = np.maximum.accumulate(np.where(fresh, slots, 0))
        slots = slots[~(fresh & np.append(fresh[1:], True))]
        if not len(slots):
            return suffixes, place
        open_ones = suffixes[slots]
        later = open_ones + size
        second = np.where(later < end[open_ones], place[np.minimum(later, n - 1)], -1)
        key = place[open_ones] * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        sorted_key, order = key[by], open_ones[by]
        suffixes[slots] = order
        size *= 2


def common_prefixes(words: np.ndarray, begin: np.ndarray, end: np.ndarray, suffixes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The words that each suffix shares with the one before it in the array of its text; 0 for the first one."""
    n = len(words)
    out = np.zeros(n, np.int64)
    slots = np.flatnonzero(begin[suffixes[1:]] == begin[suffixes[:-1]]) + 1
    for shared in range(SHORT):
        a, b = suffixes[slots - 1] + shared, suffixes[slots] + shared
        inside = (a < end[suffixes[slots]]) & (b < end[suffixes[slots]])
        inside[inside] = words[a[inside]] == words[b[inside]]
        slots = slots[inside]
        out[slots] = shared + 1
    for at in np.unique(begin[suffixes[slots]]).tolist():
        stop = int(end[at])
        own, before, where = words[at:stop].tolist(), suffixes[at:stop].tolist(), place[at:stop].tolist()
        counts, shared, length = [0] * (stop - at), 0, stop - at
        for i in range(length):  # a suffix shares at most one word less than the suffix before it in the text
            slot = where[i] - at
            if not slot:
                shared = 0
                continue
            j = before[slot - 1] - at
            room = length - max(i, j)
            while shared < room and own[i + shared] == own[j + shared]:
                shared += 1
            counts[slot] = shared
            if shared:
                shared -= 1
        out[at:stop] = counts
    return out


def intervals(prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each slot with a common prefix: the first slot of its interval, and the one after its last."""
    n = len(prefixes)
    first, after = np.zeros(n, np.int64), np.full(n, n, np.int64)
    firsts, afters = first.tolist(), after.tolist()
    slots, depths = [0], [0]
    for k, depth in enumerate(prefixes.tolist()):
        while depths[-1] > depth:
            afters[slots.pop()] = k
            depths.pop()
        if not depth:
            slots[0] = k
            continue
        firsts[k] = firsts[slots[-1]] if depths[-1] == depth else slots[-1]
        slots.append(k)
        depths.append(depth)
    return np.array(firsts, np.int64), np.array(afters, np.int64)


def branching_squares(
    begin: np.ndarray, end: np.ndarray, suffixes: np.ndarray, place: np.ndarray, prefixes: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of the squares that are followed by another word than their period goes on with."""
    inner = np.flatnonzero(prefixes)
    if not len(inner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, after = intervals(prefixes)
    inner = inner[np.argsort(first[inner] * (int(prefixes.max()) + 1) + prefixes[inner], kind="stable")]
    low, high, depth = first[inner], after[inner], prefixes[inner]
    fresh = np.ones(len(inner), bool)
    fresh[1:] = (low[1:] != low[:-1]) | (depth[1:] != depth[:-1])
    number = np.cumsum(fresh) - 1
    # children: one from the interval's first slot on, one from each slot whose prefix is the depth
    stops = np.where(np.append(fresh[1:], True), high, np.append(inner[1:], 0))
    child_of = np.concatenate((number[fresh], number))
    child_low = np.concatenate((low[fresh], inner))
    child_high = np.concatenate((inner[fresh], stops))
    low, high, depth = low[fresh], high[fresh], depth[fresh]
    by_size = np.lexsort((child_high - child_low, child_of))
    small = by_size[:-1][child_of[by_size[1:]] == child_of[by_size[:-1]]]  # all but the largest of each interval
    sizes = np.cumsum(child_high[small] - child_low[small])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(small):
        done = sizes[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, done + HELD, "right")))
        some = small[at:stop]
        at = stop
        length = child_high[some] - child_low[some]
        child = np.repeat(some, length)
        slot = np.arange(len(child)) - np.repeat(np.cumsum(length) - length, length) + child_low[child]
        own, here = child_of[child], suffixes[slot]
        step = depth[own]
        for other, there in ((here + step, here + step < end[here]), (here - step, here - step >= begin[here])):
            slot = place[other[there]]
            c, o = child[there], own[there]
            square = (slot >= low[o]) & (slot < high[o]) & ((slot < child_low[c]) | (slot >= child_high[c]))
            found.append((np.minimum(here[there], other[there])[square], step[there][square]))
    starts, periods = (np.concatenate(x) for x in zip(*found))
    both = np.unique(np.stack((starts + 2 * periods, periods), axis=1), axis=0)  # by end, then period
    return both[:, 0] - 2 * both[:, 1], both[:, 1]


def rotations(words: np.ndarray, begin: int, start: int, period: int) -> int:
    """How many words a square can be rotated to the left."""
    moved, size = 0, 32
    while start - moved > begin:
        a, b = max(begin, start - moved - size), start - moved
        other = np.flatnonzero(words[a:b] != words[a + period : b + period])
        if len(other):
            return moved + b - a - 1 - int(other[-1])
        moved += b - a
        size *= 2
    return moved


def find_runs(words: np.ndarray, firsts: np.ndarray, least: int, powers: int) -> list[tuple[int, int, int]]:
    """``(start, end, period)`` of all runs of ``max(least, powers * period)`` words or more, by start and period.

    ``firsts`` has the first word of each text, one entry more than texts; places are those in ``words``.
    """
    if not len(words):
        return []
    counts = np.diff(firsts)
    text = np.repeat(np.arange(len(counts)), counts)
    begin, end = firsts[:-1][text], firsts[1:][text]
    suffixes, place = suffix_array(words, text, end)
    prefixes = common_prefixes(words, begin, end, suffixes, place)
    starts, periods = branching_squares(begin, end, suffixes, place, prefixes)
    # a square that cannot be rotated far enough is in no run of the wanted length
    more = np.maximum(least - 2 * periods, (powers - 2) * periods)
    far = starts - more >= begin[starts]
    near = far & (more > 0)
    far[near] = words[starts[near] - 1] == words[starts[near] - 1 + periods[near]]
    runs: list[tuple[int, int, int]] = []
    ending, known = -1, []
    for start, period in zip(starts[far].tolist(), periods[far].tolist()):
        if start + 2 * period != ending:
            ending, known = start + 2 * period, []
        if any(period % q == 0 and s <= start for s, q in known):
            continue
        whole = start - rotations(words, int(begin[start]), start, period)
        if ending - whole >= max(least, powers * period):
            known.append((whole, period))
            runs.append((whole, ending, period))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def text_runs(bodies: list[bytes], least: int, powers: int):
    """For each text its words, its runs, and which words stay when all but the first period of each run goes."""
    lists = [b.split() for b in bodies]  # parts bytes at the ASCII white space, as the contract has it
    numbers: dict[bytes, int] = {}
    words = np.array([numbers.setdefault(w, len(numbers)) for own in lists for w in own], np.int64)
    firsts = np.cumsum([0, *map(len, lists)])
    runs: list[list[tuple[int, int, int]]] = [[] for _ in lists]
    for run in find_runs(words, firsts, least, powers):
        runs[int(np.searchsorted(firsts, run[0], "right")) - 1].append(run)
    for own, found, at in zip(lists, runs, firsts.tolist()):
        kept = own
        if found:
            gone = np.zeros(len(own) + 1, np.int64)
            for start, end, period in found:
                gone[start + period - at] += 1
                gone[end - at] -= 1
            kept = [w for w, g in zip(own, np.cumsum(gone).tolist()) if not g]
        yield len(own), [(a - at, b - a, q) for a, b, q in found], kept


def periodic_runs(
    df: DataFrame, text: str = "text", keep: list[str] | None = None, least: int = 6, powers: int = 4
) -> DataFrame:
    """Add ``n_words``, ``runs`` and ``collapsed`` to the columns in ``keep`` (all).

    Runs have ``max(least, powers * period)`` words at least (``powers`` 2 or more), and ``start`` and ``length`` in words
    between ASCII white space. ``collapsed`` has the words, joined by single spaces, without those that any run holds after
    its first period.
    """
    if powers < 2:
        raise ValueError("runs are made of squares: powers must be 2 or more")
    results = ["n_words", "runs", "collapsed"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in results]

    def run(batch: pa.RecordBatch):
        column = batch.column(batch.num_columns - 1)
        for first in range(0, batch.num_rows, 1024):
            bodies = [b or b"" for b in column.slice(first, 1024).cast(pa.binary()).to_pylist()]
            for a, b in text_slices(bodies, SLICE):
                out = {c: batch.column(i).slice(first + a, b - a) for i, c in enumerate(keep)}
                n, runs, kept = zip(*text_runs(bodies[a:b], least, powers))
                spans = [[{"start": s, "length": k, "period": q} for s, k, q in own] for own in runs]
                yield out | {"n_words": list(n), "runs": spans, "collapsed": [b" ".join(k).decode() for k in kept]}

    source = with_text_last(df, keep, text)
    added = T.StructType.fromDDL(f"n_words bigint, runs {RUNS}, collapsed string")
    return map_arrow(source, run, T.StructType([*source.schema.fields[:-1], *added.fields]))
