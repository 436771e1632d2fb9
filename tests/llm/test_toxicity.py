import random

import numpy as np
import pytest

from barspark.llm import toxicity as X

from .llm_samples import AWKWARD, words

BAD = ["vilefoo", "grimbar", "mudqux"]


def toxic(seed):
    rng, w = random.Random(seed), words(60, seed).split()
    for _ in range(4):
        w[rng.randrange(len(w))] = rng.choice(BAD) + rng.choice(["", "s", "ing"])
    return " ".join(w)


@pytest.fixture(scope="module")
def tables(spark, make):
    rows = [(k, toxic(k) if k % 5 == 0 else words(60, k)) for k in range(600)]
    labels = [(k, 1, int(k % 5 == 0)) for k in range(450)] + [(None, 1, 1), (3, 1, None), (4, 1, 0), (10**6, 0, 1)]
    return make(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_documents(tables):
    docs, labels = tables
    model = X.fit(docs, labels)
    assert len(model[0]) < 20_000
    held = X.score(docs, model, keep=["doc_id"]).where("doc_id >= 450").collect()
    assert len(held) == 150 and all(0 <= r.score <= 1 for r in held)
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 5 == 0) for r in held]) > 0.97


def test_same_weights_for_any_partitioning(tables):
    docs, labels = tables
    one, other = X.fit(docs.coalesce(1), labels), X.fit(docs.repartition(7, "text"), labels.repartition(3))
    assert one[0].tolist() == other[0].tolist() and one[1].tolist() == other[1].tolist() and one[2] == other[2]


def test_sample_bound(tables):
    docs, labels = tables
    assert X.fit(docs, labels, positives=20, negatives=30) is not None


def test_scores_keep_their_level_when_labels_are_thinned(spark, make):
    docs = make([(k, words(20, 10_000 + k)) for k in range(1200)])
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(1000)], "doc_id bigint, toxic int")
    for sample in ({}, {"positives": 100, "negatives": 100}, {"positives": 50, "negatives": 300}, {"positives": 30}):
        held = X.score(docs, X.fit(docs, labels, **sample), keep=["doc_id"]).where("doc_id >= 1000").collect()
        assert 0.04 < np.mean([r.score for r in held]) < 0.22, sample


def test_awkward_rows(tables, awkward, empty):
    docs, labels = tables
    model = X.fit(docs, labels)
    got = X.score(awkward, model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not (r.text or "").strip()}) == 1
    assert X.score(empty, model).count() == 0
    assert X.fit(docs, labels.limit(0)) is None and X.fit(empty, labels) is None
    assert {r.score for r in X.score(awkward, None).collect()} == {0.0}


def test_weights_are_sparse_and_ftrl_learns():
    rng = np.random.default_rng(0)
    rows = [(np.unique(np.append(rng.integers(10, 500, 8), 3 if k % 2 else 4)).astype(np.int32), k % 2) for k in range(400)]
    numbers, values, _ = X.ftrl(rows, 3, 0.5, 1.0, 5.0, 1.0)
    weights = dict(zip(numbers.tolist(), values.tolist()))
    assert weights[3] > 1 and weights[4] < -1 and len(weights) < 60
