import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from barspark.llm import periodic as P
from barspark.llm.queries import QUERIES

from .llm_samples import AWKWARD


def brute(words, least=6, powers=4):
    """``(start, length, period)`` by a look at every period and place."""
    n, found = len(words), {}
    for q in range(1, n // powers + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, powers * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def texts_of(seed, count=400):
    rng = random.Random(seed)
    for _ in range(count):
        words = rng.choices("abcd"[: rng.randint(1, 4)], k=rng.randint(0, 70))
        if words and rng.random() < 0.6:
            a = rng.randrange(len(words))
            p = 1 + rng.randrange(max(1, (len(words) - a) // 3))
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            if rng.random() < 0.4:
                words[rng.randrange(len(words))] = "z"
        yield words


@pytest.mark.parametrize("least, powers", [(6, 4), (2, 2), (1, 3), (9, 5)])
@pytest.mark.parametrize("held", [5, 2_000_000])
def test_runs_equal_brute_force(monkeypatch, least, powers, held):
    monkeypatch.setattr(P, "HELD", held)
    texts = list(texts_of(powers))
    got = list(P.text_runs([" ".join(w).encode() for w in texts], least, powers))
    for words, (n, runs, left) in zip(texts, got):
        want = brute(words, least, powers)
        assert (n, runs) == (len(words), want)
        assert [w.decode() for w in left] == kept(words, want)


def test_arrays_equal_sorted_suffixes():
    texts = list(texts_of(9, 30))
    words = np.array([ord(w) for t in texts for w in t], np.int64)
    firsts = np.cumsum([0, *map(len, texts)])
    text = np.repeat(np.arange(len(texts)), np.diff(firsts))
    begin, end = firsts[:-1][text], firsts[1:][text]
    suffixes, place = P.suffix_array(words, text, end)
    prefixes = P.common_prefixes(words, begin, end, suffixes, place)
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        order = sorted(range(a, b), key=lambda i: words[i:b].tolist())
        assert suffixes[a:b].tolist() == order
        shared = [0]
        for i, j in zip(order, order[1:]):
            k = 0
            while max(i, j) + k < b and words[i + k] == words[j + k]:
                k += 1
            shared.append(k)
        assert prefixes[a:b].tolist() == (shared if b > a else [])
    assert place[suffixes].tolist() == list(range(len(words)))


def test_long_texts():
    assert list(P.text_runs([b"a " * 60_000 + b"b"], 6, 4)) == [(60_001, [(0, 60_000, 1)], [b"a", b"b"])]
    n, runs, left = next(P.text_runs([b"x " + b"a b c " * 20_000], 6, 4))
    assert runs == [(1, 60_000, 3)] and left == [b"x", b"a", b"b", b"c"]


def test_awkward_rows(awkward, empty):
    got = P.periodic_runs(awkward)
    assert got.columns == [c for c in awkward.columns if c != "runs"] + ["n_words", "runs", "collapsed"]
    rows = got.collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        want = brute(words) if len(words) < 1000 else None
        found = [(x.start, x.length, x.period) for x in r.runs]
        assert r.n_words == len(words)
        if want is not None:
            assert found == want
        assert r.collapsed == " ".join(kept(words, found))
    assert [(x.start, x.length, x.period) for x in next(r for r in rows if r.doc_id == 10).runs] == [(0, 700, 1)]
    assert P.periodic_runs(empty).count() == 0
    with pytest.raises(ValueError):
        P.periodic_runs(empty, powers=1)


def test_query_equals_brute_force(spark, tmp_path, make):
    rng = random.Random(3)
    rows = [(i, " \n ".join(rng.choices("abc", k=rng.randint(0, 90)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (None, "a " * 9), (None, None), (5, "b\x0bb\x0cb b b b\x1cb"), (5, "b\x0bb\x0cb b b b")]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(words)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{b},{q}\n" for a, b, q in runs), " ".join(kept(words, runs)))]
        want.append((i, len(runs), *best, None if best[2] is None else 1000 * best[1] // best[2], *digest))
    got = [tuple(r) for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
