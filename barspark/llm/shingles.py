"""Word shingles of whole texts as sorted 64-bit hashes, and their SuperMinHash signatures, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

GOLD = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text that are hashed at a time, unless one text is longer.
SLICE = 1_000_000
#: White space that parts words.
SPACES = [0x20, *range(0x09, 0x0E)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * GOLD)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[SPACES] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins; a null has none."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE):
    """Runs of texts of about ``limit`` bytes, one text at least."""
    begin, n = 0, len(offsets) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1)
        yield begin, min(end, n)
        begin = min(end, n)


def word_hashes(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word (A-Z lower-cased), and the first word of each text (one entry more than texts)."""
    n = len(flat)
    inside = ~IS_SPACE[flat]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts_of_texts = offsets[:-1][offsets[:-1] < n]
    begins[starts_of_texts] = inside[starts_of_texts]  # words never cross texts
    starts = np.flatnonzero(begins)
    firsts = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), firsts
    # sum of byte value * BASE ** place in the word, over the bytes of the word; spaces add nothing
    place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n))) if starts[0] == 0 else None
    if place is None:
        place = np.arange(n)
        place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, n)))
    powers = np.ones(int(place.max()) + 1, np.uint64)
    np.multiply.accumulate(np.full(len(powers) - 1, BASE), out=powers[1:])
    values = BYTE_VALUES[LOWER[flat]] * powers[place]
    values[~inside] = 0
    return mix(np.add.reduceat(values, starts)), firsts


def shingle_sets(words: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after the other, and where each text's begin."""
    n = len(words)
    full = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        full = mix((full + words[k : k + len(full)]) * GOLD + np.uint64(k))
    sets: list[np.ndarray] = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        if b - a >= width:
            sets.append(np.unique(full[a : b - width + 1]))
        elif b > a:  # fewer words: the whole sequence
            value = np.zeros(1, np.uint64)
            for k, w in enumerate(words[a:b]):
                value = mix((value + w) * GOLD + np.uint64(k + 64 * (b - a)))
            sets.append(value)
        else:
            sets.append(np.zeros(0, np.uint64))
    ends = np.cumsum([0, *map(len, sets)])
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), ends


FRACTION = np.uint64(40)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Permutation entries held at a time for the elements of small sets.
HELD = 6_000_000


def super_minhash(elements: np.ndarray, ends: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures of sets, a row each: whole part and 40 bits of fraction.

    In round ``j`` every element of a set offers ``j + r`` to the ``j``-th place of its own random permutation. The
    rounds run in lockstep, and a set leaves as soon as all places hold less than ``j + 1``: nothing later can be
    smaller. Large sets leave after the first rounds; only the others need the shuffled permutations.
    """
    sizes = np.diff(ends)
    sets = len(sizes)
    signature = np.full((sets, m), EMPTY, np.uint64)
    owner = np.repeat(np.arange(sets), sizes)
    _offer(signature, owner, *_draw(elements, 0, m), 0)
    open_sets = np.flatnonzero((signature == EMPTY).any(axis=1) & (sizes > 0))
    begin, limit = 0, max(1, HELD // m)
    while begin < len(open_sets):
        end = max(begin + 1, int(np.searchsorted(np.cumsum(sizes[open_sets[begin:]]), limit, "right")) + begin)
        some = open_sets[begin:end]
        begin = end
        at = np.concatenate([np.arange(ends[s], ends[s + 1]) for s in some.tolist()])
        own, who = elements[at], owner[at]
        order = np.tile(np.arange(m, dtype=np.uint16), (len(own), 1))
        for j in range(m):
            fraction, to = _draw(own, j, m)
            rows = np.arange(len(own))
            slot = order[rows, to]
            order[rows, to] = order[:, j]
            order[:, j] = slot
            if j:
                _offer(signature, who, fraction, slot.astype(np.int64), j)
                done = signature[some].max(axis=1) < np.uint64(j + 1) << FRACTION
                if done.any():
                    some = some[~done]
                    if not len(some):
                        break
                    keep = np.isin(who, some)
                    own, who, order = own[keep], who[keep], order[keep]
    return signature


def _draw(elements: np.ndarray, j: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Round ``j``: the fraction of each element's value, and the place that is exchanged with ``j``."""
    bits = mix(elements + np.uint64((j + 1) * int(GOLD) & int(EMPTY)))
    to = np.uint64(j) + (((bits & np.uint64(0xFFFFFF)) * np.uint64(m - j)) >> np.uint64(24))
    return bits >> np.uint64(24), to.astype(np.int64)


def _offer(signature: np.ndarray, owner: np.ndarray, fraction: np.ndarray, slot: np.ndarray, j: int) -> None:
    np.minimum.at(signature.reshape(-1), owner * signature.shape[1] + slot, fraction + (np.uint64(j) << FRACTION))


def band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    """A hash for each band of a signature, the band's number included."""
    rows = signature.shape[1] // bands
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    value = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * BASE, parts.shape[:2]).copy()
    for k in range(rows):
        value = mix((value + parts[:, :, k]) * GOLD)
    return value


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct sets that are not empty."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    place = np.searchsorted(large, small)
    place[place == len(large)] = len(large) - 1
    both = int((large[place] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
