import random
import re

import numpy as np
import pytest

from barspark.llm import near_dedup as N
from barspark.llm import shingles as S
from barspark.llm.components import connected_components

from .llm_samples import AWKWARD, words


def shingle_set(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def edited(text, changes, seed):
    rng, w = random.Random(seed), text.split()
    for k in range(changes):
        w[rng.randrange(len(w))] = f"new{seed}x{k}"
    return " ".join(w)


def family(base, copies, changes, first):
    return [(first + k, edited(words(120, base), changes, first + k)) for k in range(copies)]


def brute(rows, width=4):
    """Component and set size by id, linking all pairs."""
    sets = {}
    for doc, text in rows:
        if doc is not None:
            sets[doc] = shingle_set(text, width)
    head = {d: d for d in sets}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                head[y] = x
    return {d: (find(d), len(s)) for d, s in sets.items()}


def test_word_and_shingle_hashes_follow_the_words():
    texts = [t for _, t in AWKWARD] + ["", "A b\x1cc", "\x0bq\x0c", "é É", "  lead", "trail  "]
    import pyarrow as pa

    for width in (1, 4, 5):
        flat, offsets = S.text_bytes(pa.array(texts, pa.string()))
        elements, ends = S.shingle_sets(*S.word_hashes(flat, offsets), width)
        seen = {}
        for k, text in enumerate(texts):
            own, expected = elements[ends[k] : ends[k + 1]], shingle_set(text, width)
            assert len(own) == len(expected) and (np.diff(own.astype(object)) > 0).all()
            for j in range(k):
                other = shingle_set(texts[j], width)
                assert len(expected & other) == len(np.intersect1d(own, seen[j]))
            seen[k] = own


def slow_super_minhash(elements, m):
    """The same rounds, one element after the other, without early stopping."""
    out = [float("inf")] * m
    for e in elements:
        order = list(range(m))
        for j in range(m):
            fraction, to = S._draw(np.array([e], np.uint64), j, m)
            t = int(to[0])
            order[j], order[t] = order[t], order[j]
            out[order[j]] = min(out[order[j]], (j << 40) + int(fraction[0]))
    return out


def test_super_minhash_stops_early_without_a_difference():
    rng = np.random.default_rng(1)
    sizes = [1, 2, 7, 40, 300]
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in sizes]
    got = S.super_minhash(np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes))), 30)
    for row, own in zip(got.tolist(), sets):
        assert row == slow_super_minhash(own, 30)


def test_signature_estimates_the_similarity():
    a, b = np.arange(900, dtype=np.uint64), np.arange(100, 1000, dtype=np.uint64)
    s = S.super_minhash(S.mix(np.concatenate((a, b))), np.array([0, 900, 1800]), 2000)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.04


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 3), (3, 9), (2, 8), (9, 5)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 50)]])
def test_components(spark, edges):
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    nodes = {}
    for a, b in edges:
        for x in (a, b):
            if a != b:
                nodes.setdefault(x, x)
    for _ in nodes:
        for a, b in edges:
            if a != b:
                nodes[a] = nodes[b] = min(nodes[a], nodes[b])
    assert {r.node: r.component for r in got.collect()} == nodes


ROWS = (
    [r for r in AWKWARD if r[0] is not None]
    + family(70, 25, 2, 100) + family(71, 40, 5, 200) + family(72, 12, 12, 300)
    + [(400 + k, "same words here") for k in range(20)] + [(500, "same words"), (501, "one two three four five"), (502, "one two three four six")]
)


@pytest.mark.parametrize("width,block", [(4, 1024), (5, 7)])
def test_components_equal_brute_force(make, monkeypatch, width, block):
    monkeypatch.setattr(N, "BLOCK", block)
    got = N.near_duplicates(make(ROWS), width=width).collect()
    expected = brute(ROWS, width)
    assert len(got) == len(ROWS)
    for r in got:
        assert (r.component_id, r.n_shingles) == expected[r.doc_id]
        assert r.kept == (r.component_id == r.doc_id)


def test_null_ids_and_empty_tables(make, empty):
    rows = [(None, words(30, 1)), (4, words(30, 1)), (None, None), (None, words(30, 9))]
    got = sorted(map(str, N.near_duplicates(make(rows)).select("doc_id", "component_id", "kept").collect()))
    assert got == sorted([
        "Row(doc_id=None, component_id=4, kept=False)", "Row(doc_id=4, component_id=4, kept=True)",
        "Row(doc_id=None, component_id=None, kept=True)", "Row(doc_id=None, component_id=None, kept=True)",
    ])
    assert N.near_duplicates(empty).count() == 0


def test_rows_of_one_id_with_different_texts(make):
    a, b, c = words(60, 21), words(60, 22), words(60, 23)
    rows = [(3, a), (5, edited(a, 1, 1)), (5, b), (9, edited(b, 1, 2)), (9, edited(b, 1, 2)), (None, c), (None, edited(c, 1, 3)), (None, ""), (None, "")]
    rows += [(1, edited(c, 1, 4))] * 2
    got = N.near_duplicates(make(rows)).collect()
    assert len(got) == len(rows)
    seen = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got)
    assert seen == sorted(
        [(3, 3, True), (5, 3, False), (5, 5, True), (9, 5, False), (9, 5, False), (0, 1, False), (0, 1, False), (0, 0, True), (0, 0, True)]
        + [(1, 1, True)] * 2
    )
    chosen = [(r.doc_id, r.n_shingles > 0) for r in got if r.chosen]
    assert sorted(map(repr, chosen)) == sorted(map(repr, [(3, True), (5, True), (None, False), (None, False), (1, True), (1, True)]))


def test_one_row_of_a_component_without_ids_is_chosen(make):
    a = words(60, 31)
    got = N.near_duplicates(make([(None, a), (None, edited(a, 1, 1)), (None, edited(a, 1, 2))])).collect()
    assert [r.chosen for r in got].count(True) == 1 and all(r.component_id is None for r in got)


def test_an_id_that_many_texts_share(make):
    rows = [(7, words(30, 400 + k)) for k in range(300)] + [(8, words(30, 450))]
    got = N.near_duplicates(make(rows)).collect()
    assert all(r.component_id == 7 for r in got) and sum(r.chosen for r in got) == 300
