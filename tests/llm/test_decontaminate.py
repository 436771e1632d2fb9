import re

import pytest

from barspark.llm import decontaminate as D

from .llm_samples import AWKWARD, words

ITEMS = [(1, words(25, 50)), (10, words(25, 50)), (2, "three short words"), (3, ""), (4, None), (None, words(30, 51)), (5, words(10, 52))]
DOCS = AWKWARD + [
    (20, words(5, 60) + ". " + words(25, 50).upper() + "; " + words(5, 61)),
    (21, "Three, SHORT words and three short words"),
    (22, " ".join(words(25, 50).split()[3:14]) + " " + words(3, 62)),
    (23, " ".join(words(25, 50).split()[3:12])),  # nine words: no window
    (24, words(10, 52)),
    (24, words(10, 52)),
]


def brute(docs, items, width=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for item, body in items:
            v = split(body)
            n = min(width, len(v))
            if item is None or not n:
                continue
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found.add(item)
        out.append((repr(doc), len(w), len(hit), sorted(found)))
    return sorted(out)


@pytest.fixture(scope="module")
def benchmark_table(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


def rows_of(hits):
    return sorted((repr(r.doc_id), r.n_words, sum(x.end - x.start for x in r.hits), list(r["items"])) for r in hits.collect())


def test_hits_equal_brute_force(make, empty, benchmark_table):
    assert rows_of(D.find_hits(make(DOCS), benchmark_table)) == brute(DOCS, ITEMS)
    assert D.digest(D.find_hits(empty, benchmark_table)).count() == 0
    none = D.digest(D.find_hits(make(DOCS), benchmark_table.limit(0)))
    assert none.where("contaminated").count() == 0 and none.count() == len(DOCS)


def test_many_slices_give_the_same(make, benchmark_table, monkeypatch):
    monkeypatch.setattr(D, "SLICE_ITEMS", 1)
    assert rows_of(D.find_hits(make(DOCS), benchmark_table)) == brute(DOCS, ITEMS)
    cleaned = D.remove_spans(make(DOCS), benchmark_table)
    assert rows_of(D.find_hits(cleaned, benchmark_table)) == brute([(r.doc_id, r.text) for r in cleaned.collect()], ITEMS)


def test_spans_over_slices_equal_one_slice(spark, make, monkeypatch):
    w, a, b = words(40, 70).split(), words(6, 71), words(6, 72)
    join = lambda *parts: " ".join(x if isinstance(x, str) else " ".join(x) for x in parts)
    items = [
        (1, join(w[:14])), (2, join(w[9:24])), (3, join(w[20:32])),  # overlap each other
        (4, join(a, b)), (5, join(w[30:])),
        (6, join(w[:5], a.split()[:3])),
    ]
    rows = [
        (1, join("before", w[:32], "after")),
        (2, join(w[:24])),  # nothing is left by two items together
        (3, join("x", a, w[:14], b, "y")),  # closes up over one item to another
        (4, join("x", a, w[:24], b, w[30:], "y")),
        (5, join(w[2:13], w[9:20], "z")),
        (6, None), (7, "clean text"), (7, "clean text"),
        (8, join(w[:5], w[30:], a.split()[:3], "tail")),
    ]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    left = lambda n: sorted((r.doc_id, r.text or "") for r in D.remove_spans(make(rows), table, least_left=n).collect())
    one = {n: left(n) for n in (1, 4)}
    assert dict(one[1])[1] == "before  after" and 2 not in dict(one[1]) and dict(one[1])[3] == "x  y"
    for size in (1, 2):
        monkeypatch.setattr(D, "SLICE_ITEMS", size)
        assert {n: left(n) for n in one} == one


def test_removed_spans_leave_clean_texts(make, benchmark_table):
    cleaned = D.remove_spans(make(DOCS), benchmark_table)
    left = {r.doc_id: r.text for r in cleaned.collect()}
    assert cleaned.columns == make([]).columns
    assert left[20] == words(5, 60) + ". ; " + words(5, 61)
    assert left[21] == " and " and 24 not in left
    for doc, text in AWKWARD:
        assert left[doc] == text
    assert all(not n for _, _, n, _ in rows_of(D.find_hits(cleaned, benchmark_table)))
