import hashlib
from collections import Counter

import numpy as np
import pytest

from barspark.llm import byte_runs as B
from barspark.llm import chunk_dedup as C
from barspark.llm import suffix_dedup as X

from .llm_samples import AWKWARD, words

PASSAGE = words(70, 90)
ROWS = AWKWARD + [
    (30, words(30, 91) + " " + PASSAGE + " " + words(30, 92)),
    (31, words(11, 93) + " " + PASSAGE + " " + words(50, 94)),
    (32, words(300, 95) + PASSAGE + PASSAGE[:150] + words(20, 96)),
    (33, words(300, 95)[:1200]),
    (34, "ab" * 400 + words(60, 97) + "ab" * 300),
    (35, words(60, 97)[:199]),
    (36, words(60, 97)[:200]),
    *[(40 + k, words(20, 40 + k) + PASSAGE[: 180 + 4 * k] + words(20, 60 + k)) for k in range(12)],
]


def runs_to_row(doc, body, removed):
    edges = np.diff(np.concatenate(([0], removed.astype(int), [0])))
    kept = np.frombuffer(body, np.uint8)[~removed].tobytes()
    return repr(doc), len(body), int(removed.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()


def result(df):
    return sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in B.digest(df).collect())


def brute_strings(rows, length):
    bodies = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[k : k + length] for _, b in bodies for k in range(len(b) - length + 1))
    out = []
    for doc, body in bodies:
        gone = np.zeros(len(body), bool)
        for k in range(len(body) - length + 1):
            if seen[body[k : k + length]] > 1:
                gone[k : k + length] = True
        out.append(runs_to_row(doc, body, gone))
    return sorted(out)


def test_repeated_strings_equal_brute_force(make, empty):
    assert result(X.remove_repeats(make(ROWS))) == brute_strings(ROWS, 200)
    assert result(X.remove_repeats(empty)) == []


def test_split_anchors(make, monkeypatch):
    monkeypatch.setattr(X, "SPLIT", 2)
    monkeypatch.setattr(X, "SHARD", 2000)
    monkeypatch.setattr(X, "ARRAY", 700)
    assert result(X.remove_repeats(make(ROWS))) == brute_strings(ROWS, 200)
    assert result(X.remove_repeats(make(ROWS), length=64)) == brute_strings(ROWS, 64)


def test_texts_longer_than_a_piece(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(B, "PIECE", 700)
    texts = [t for _, t in ROWS]
    expected, got = set(), set()
    for size, out in ((10**6, expected), (700, got)):
        monkeypatch.setattr(B, "PIECE", size)
        for data, rows, places, bases in B.pieces(pa.array(texts, pa.string()), 199):
            first, last, _, _, part = X.homes(data, places, 200, 48)
            for a, b, p in zip(first.tolist(), last.tolist(), part.tolist()):
                for k in range(a, b + 1):
                    at = k - int(places[p]) + int(bases[p])
                    assert (int(rows[p]), at) not in out
                    out.add((int(rows[p]), at))
                    assert data[k : k + 200].tobytes() == texts[rows[p]].encode()[at : at + 200]
    assert expected == got == {(i, k) for i, t in enumerate(texts) for k in range(len((t or "").encode()) - 199)}


@pytest.mark.parametrize("seed", range(3))
def test_suffix_array_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    parts = [rng.choice(list(b"ab"), n).astype(np.uint8).tobytes() * int(rng.integers(1, 4)) for n in rng.integers(20, 60, 30)]
    length = 20
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    stop = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(parts)), sizes)
    starts = np.flatnonzero(np.arange(len(data)) <= (stop - length)[owner])
    for group in (np.zeros(len(data), np.int64), owner // 4):
        order, word = X.suffix_array(data, stop[owner], starts, length, group)
        strings = [data[k : k + length].tobytes() for k in order.tolist()]
        keys = list(zip(group[order].tolist(), strings))
        assert keys == sorted(keys) and sorted(order.tolist()) == starts.tolist()
        shared = X.common_prefixes(order, word, stop - sizes, stop - length, length)
        expected = [0] + [next((i for i in range(length) if a[i] != b[i]), length) for a, b in zip(strings, strings[1:])]
        assert shared.tolist() == expected


def brute_chunks(rows):
    """Chunks byte by byte; the first place of each keeps it."""
    gear, chunks, firsts = C.GEAR.tolist(), [], {}
    for doc, text in rows:
        body, at, h, own = (text or "").encode(), 0, 0, []
        for k, x in enumerate(body):
            h = ((h << 1) + gear[x]) & 0xFFFFFFFF
            if k + 1 - at == C.MOST or (k + 1 - at >= C.LEAST and h >> (32 - C.TOP_BITS) == 0):
                own.append((at, k + 1))
                at = k + 1
        if at < len(body):
            own.append((at, len(body)))
        chunks.append((doc, body, own))
    key = lambda d: (d is not None, d or 0)
    for doc, body, own in sorted(chunks, key=lambda c: key(c[0])):
        for a, b in own:
            firsts.setdefault(body[a:b], (doc, a))
    bodies = {doc: body for doc, body, _ in chunks}
    out = []
    for doc, body, own in chunks:
        runs = []
        for a, b in own:
            d, s = firsts[body[a:b]]
            if (d, s) == (doc, a):
                continue
            if runs and runs[-1][1] == a and runs[-1][2] == d and s - a == runs[-1][3] - runs[-1][0]:
                runs[-1][1] = b
            else:
                runs.append([a, b, d, s])
        gone = np.zeros(len(body), bool)
        for a, b, d, s in runs:
            other, left, right, e = bodies[d], 0, 0, s + b - a
            while left < min(C.REACH, a, s) and body[a - left - 1] == other[s - left - 1]:
                left += 1
            while right < min(C.REACH, len(body) - b, len(other) - e) and body[b + right] == other[e + right]:
                right += 1
            if left + b - a + right >= C.PASSAGE or left + b - a + right == len(body):
                gone[a - left : b + right] = True
        out.append(runs_to_row(doc, body, gone))
    return sorted(out)


def test_chunks_equal_brute_force(make, empty):
    assert result(C.remove_repeats(make(ROWS))) == brute_chunks(ROWS)
    assert result(C.remove_repeats(empty)) == []


def test_common_bytes():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = (rng.choice(list(b"ab"), rng.integers(0, 12), p=[0.9, 0.1]).astype(np.uint8).tobytes() for _ in "ab")
        assert C.common_bytes(a, b) == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_shared_passages_go_whole_and_clean_texts_stay(make):
    rows = [(k, words(40 + k, 700 + k) + " " + PASSAGE + " " + words(30, 800 + k)) for k in range(8)]
    rows += [(100 + k, words(200, 900 + k)) for k in range(20)]
    got = {r.doc_id: r.n_removed for r in C.remove_repeats(make(rows)).collect()}
    whole = len(PASSAGE.encode())
    assert got[0] == 0 and all(whole <= got[k] <= whole + 12 for k in range(1, 8)) and not any(got[100 + k] for k in range(20))


def test_passages_of_just_over_fifty_words_go(make):
    passages = [words(51 + k % 10, 5000 + k) for k in range(200)]
    rows = [(k, words(40, 6000 + k) + " " + p + " " + words(40, 7000 + k)) for k, p in enumerate(passages)]
    rows += [(1000 + k, words(50, 8000 + k) + " " + p + " " + words(30, 9000 + k)) for k, p in enumerate(passages)]
    got = {r.doc_id: r.n_removed for r in C.remove_repeats(make(rows)).collect()}
    shares = np.array([got[1000 + k] / len(p) for k, p in enumerate(passages)])
    assert not any(got[k] for k in range(200)) and shares.max() < 1.05
    assert (shares >= 1).mean() >= 0.98


def test_repeats_shorter_than_a_passage_stay_and_whole_texts_go(make):
    line = words(16, 5500)
    rows = [(k, words(30, 6500 + k) + "\n" + line + "\n" + words(30, 7500 + k)) for k in range(60)]
    rows += [(100, line), (101, line)]
    got = {r.doc_id: r.n_removed for r in C.remove_repeats(make(rows)).collect()}
    assert not any(got[k] for k in range(60)) and got[101] == len(line.encode())


def test_rows_that_repeat_an_id_and_text_are_one_document(make):
    rows = [(None, PASSAGE)] * 3 + [(4, PASSAGE + " " + words(9, 1))] * 300
    got = [(r.doc_id, r.n_removed) for r in C.remove_repeats(make(rows)).collect()]
    gone = dict(got)[4]
    assert sorted(map(repr, got)) == sorted(map(repr, [(None, 0)] * 3 + [(4, gone)] * 300))
    assert gone >= len(PASSAGE.encode())


def test_bitmap_keeps_every_hash(spark):
    from barspark.llm.repeats import bitmap_of, listed

    h = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 500)
    for count in (1, 500, 60_000):
        bits = bitmap_of(spark.createDataFrame([(int(x),) for x in h], "h bigint"), count)
        assert listed(bits, h.view(np.uint64)).all()
        assert listed(bits, np.arange(10_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).mean() < 0.01
