import numpy as np
import pytest

from barspark.llm import nearest as V


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, cell string, v string")


def rows_of(vectors, first=0):
    return [(first + i, [None if x is None else float(x) for x in v] if v is not None else None, 0, "x", "y") for i, v in enumerate(vectors)]


def brute(vectors, k=20):
    out = {}
    v = np.array(vectors, np.float32).astype(float)
    for q in range(0, len(v), 20):
        scores = (v * v[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(len(v)), -scores)) if i != q][:k]
        out[q] = [(i, scores[i]) for i in order]
    return out


@pytest.mark.parametrize("kind", ["clusters", "even"])
def test_recall_and_scores(spark, kind):
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 1, (12, 16))
    vectors = rng.normal(0, 1, (1500, 16)) if kind == "even" else centres[rng.integers(0, 12, 1500)] + rng.normal(0, 0.3, (1500, 16))
    got = V.search(table(spark, rows_of(vectors)), codes=16, block=300).collect()
    expected, found = brute(vectors), {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(found) == set(expected)
    hits = 0
    for q, own in found.items():
        assert sorted(own) == list(range(1, 21))
        listed = [own[k] for k in range(1, 21)]
        assert listed == sorted(listed, key=lambda x: (-x[1], x[0])) and q not in [i for i, _ in listed]
        truth = dict(brute(vectors, len(vectors))[q])
        assert all(abs(truth[i] - s) < 1e-12 for i, s in listed)
        hits += len({i for i, _ in listed} & {i for i, _ in expected[q]})
    assert hits >= 0.9 * 20 * len(expected)


def test_groups_hold_a_bounded_number_of_queries(spark, monkeypatch):
    vectors = np.random.default_rng(3).normal(0, 1, (600, 8))
    search = lambda: sorted(
        (r.query_id, r["rank"], r.vec_id, r.score) for r in V.search(table(spark, rows_of(vectors)), codes=8, block=100, queries="vec_id % 3 = 0").collect()
    )
    whole = search()
    cogrouped = type(spark.range(1).groupBy("id").cogroup(spark.range(1).groupBy("id")))
    apply = cogrouped.applyInArrow

    def watched(self, fn, schema):
        def run(queries, own):
            if queries.num_rows > 40 or own.num_rows > 200:
                raise ValueError(f"a group of {queries.num_rows} queries and {own.num_rows} rows")
            return fn(queries, own)

        return apply(self, run, schema)

    monkeypatch.setattr(cogrouped, "applyInArrow", watched)
    monkeypatch.setattr(V, "ASKED", 20, raising=False)
    assert search() == whole and len(whole) == 200 * 20


def test_one_vector_held_by_most_rows(spark):
    rng = np.random.default_rng(1)
    vectors = np.where(rng.random((800, 1)) < 0.6, np.ones((1, 8)), rng.normal(0, 1, (800, 8)))
    vectors[0] = 1
    got = V.search(table(spark, rows_of(vectors)), codes=8, block=100).where("query_id = 0").orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == brute(vectors)[0]


def test_awkward_rows(spark):
    vectors = [[1, 0], [0, 0], None, [], [None, 1], [float("nan"), 1], [float("inf"), 1], [0.5, 0.5], [1, 2, 3], [-1, 0]]
    rows = rows_of(vectors) + [(None, [1.0, 1.0], 0, "", ""), (7, [0.5, 0.5], 0, "", ""), (20, [0.0, 1.0], 0, "", "")]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in V.search(table(spark, rows)).collect())
    assert got == [(0, 1, 7, 0.5), (0, 2, 20, 0.0), (0, 3, 9, -1.0), (20, 1, 7, 0.5), (20, 2, 0, 0.0), (20, 3, 9, 0.0)]
    assert V.search(table(spark, [])).count() == 0
    assert V.search(table(spark, rows_of([None, [0.0]]))).count() == 0
    assert V.search(table(spark, rows_of([[1.0, 2.0]]))).count() == 0
